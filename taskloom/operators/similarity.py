"""Near-duplicate tasks: text features, an eight-signal score, and candidate selection."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.points import PART
from .. import scratch
from ..functions.textual import B, found, jaccard, let, nfkc, squeeze, sub, sub_where, text
from ..schema import RELATED_TOPICS, TOPICS_BY_CLASS
from . import setjoin
from .layout import FEW, by_rows, spread
from .setjoin import dice

# Words that carry no meaning of their own.
STOPWORDS = [
    "aufgabe", "aufgaben", "berechne", "bestimme", "ermittle", "gib", "zeichne", "skizziere", "ordne", "löse", "loese", "vereinfache", "folgende",
    "folgenden", "möglich", "moeglich", "wenn", "dabei", "nutze", "notiere", "begründe", "begrunde", "eine", "einer", "einen", "einem", "eines",
    "die", "der", "das", "den", "dem", "des", "und", "oder", "mit", "von", "für", "fuer", "zur", "zum", "im", "in", "an", "auf", "aus", "ist", "sind",
    "wird", "werden", "kann", "soll", "alle", "jeweils",
]
# Rewrites of wording, applied in order.
REWRITES = [
    (r"dr(?:ü|ue)cke[^.!?\n]{0,80}?mit (?:einem )?term aus", " term_bilden "),
    (r"(?:stelle|stell)[^.!?\n]{0,60}?(?:als|durch) (?:einen )?term (?:dar|auf)", " term_bilden "),
    (r"formuliere[^.!?\n]{0,50}?term", " term_bilden "),
    (r"verdopple|verdoppele|zweifache", " multipliziere 2 "),
    (r"verdreifache", " multipliziere 3 "),
    (r"vervierfache", " multipliziere 4 "),
    (r"verf(?:ü|ue)nffache", " multipliziere 5 "),
    (r"versechsfache", " multipliziere 6 "),
    (r"versiebenfache", " multipliziere 7 "),
    (r"verachtfache", " multipliziere 8 "),
    (r"verneunfache", " multipliziere 9 "),
    (r"verzehnfache", " multipliziere 10 "),
    (r"multipliziere|multiplizieren|malnehmen", " mult "),
    (r"dividiere|dividieren|teile durch", " div "),
    (r"subtrahiere|subtrahieren", " sub "),
    (r"addiere|addieren", " add "),
    (r"summe aus", " summe "),
    (r"differenz aus", " differenz "),
    (r"produkt aus", " produkt "),
    (r"quotient(?:en)? aus", " quotient "),
    (r"gleichung(?:en)?", " gleichung "),
    (r"terme?", " term "),
]
# Suffixes by the length that a word has to exceed.
SUFFIXES = [(7, ["ungen", "ung", "keiten", "keit", "lichen", "liche", "lich"]), (6, ["enden", "ende", "ern", "en", "es", "em"]), (5, ["er", "e", "n", "s"])]
#: Texts of which one has to occur where the rewrite of the same place changes anything.
NEEDED = [
    ["term aus"], [" term "], ["formuliere"], ["verdopple", "verdoppele", "zweifache"], ["verdreifache"], ["vervierfache"], ["nffache"], ["versechsfache"], ["versiebenfache"], ["verachtfache"], ["verneunfache"],
    ["verzehnfache"], ["multipliziere", "malnehmen"], ["dividiere", "teile durch"], ["subtrahiere"], ["addiere"], ["summe aus"], ["differenz aus"], ["produkt aus"], ["quotient"], ["gleichung"], ["term"],
]
# Fractions, roots, numbers, and mathematical tokens.
FRACTION, ROOT = r"\\frac\s*\{([^}]*)\}\s*\{([^}]*)\}", r"\\sqrt\s*\{([^}]*)\}"
NUMBER = r"(?iu)(?<![a-zäöüß])[-+]?\d+(?:[.,]\d+)?"
MATH = rf"(?i)(?:[-+]?\d+(?:[.,]\d+)?)|(?:{B}[a-z]{B})|(?:frac|sqrt|mathbb_[a-z])|(?:<=|>=|!=|=|\+|-|\*|/|\^|<|>)"
# Weights of the signals.
WEIGHTS = {"prose": 0.24, "semantic": 0.22, "literal": 0.16, "chars": 0.10, "structure": 0.08, "math": 0.09, "title": 0.06, "numbers": 0.05}
COLLECT, SHOW, STOP_AT, DESELECT, MOST = 0.46, 0.50, 0.84, 0.97, 5


def canonical(c: Column, normal: bool = True) -> Column:
    """Lower case with uniform operators and blanks. normal: in NFKC first."""
    c = F.translate(F.lower(nfkc(text(c)) if normal else text(c)), "−–—·⋅×÷", "---***/")

    def commands(x: Column) -> Column:
        for pattern, to in ((r"\\cdot|\\times", "*"), (r"\\div", "/"), (r"\\left|\\right", "")):
            x = sub(x, pattern, to)
        return x

    return squeeze(let(c, lambda x: F.when(x.contains("\\"), commands(x)).otherwise(x)))


def semantic(canon: Column) -> Column:
    """A canonical text with its wording rewritten; a rewrite runs only where a text it needs occurs."""

    def rewrite(pattern: str, to: str, needed: list[str]):
        return lambda x: F.when(reduce(or_, (x.contains(n) for n in needed)), sub(x, pattern, to)).otherwise(x)

    for (pattern, to), needed in zip(REWRITES, NEEDED):
        canon = let(canon, rewrite(pattern, to, needed))
    return squeeze(canon)


def structural(sem: Column) -> Column:
    return squeeze(sub(sem, r"\d+(?:[.,]\d+)?", "#"))


_SUFFIX = [(size, re.compile(f"(?:{'|'.join(suffixes)})$")) for size, suffixes in SUFFIXES]


def stem(word: str) -> str:
    """A word without its suffixes, each taken off only while the word is longer than its rule says."""
    for size, suffix in _SUFFIX:
        if len(word) > size:
            word = suffix.sub("", word)
    return word


class _Kept(dict):
    """Stems of words, '' for those too short or without a meaning. A worker remembers what it has met, up to a number of words.

    A word met before is looked up without a step of Python's own.
    """

    def __init__(self, least: int) -> None:
        self.least = least

    def __missing__(self, word: str) -> str:
        if len(self) >= 200_000:
            self.clear()
        w = stem(word)
        self[word] = w = w if len(w) >= self.least and w not in _STOP else ""
        return w


# Letters of words; with digits and underscores where words stand for meaning.
# All cases are listed, also those that are equal only without regard to case: a flag would fold each letter of a text.
CASES = "a-zA-ZÄÖÜäöüß\u0130\u0131\u017F\u1E9E\u212A"
_COMMAND, _LETTERS, _WORDS = re.compile(r"\\[a-z]+"), re.compile(f"[{CASES}]+"), re.compile(f"[{CASES}0-9_]+")
_FRACTION, _ROOT = re.compile(FRACTION, re.A), re.compile(ROOT, re.A)


def _prose(sem: str) -> filter:
    words = _LETTERS.findall(_COMMAND.sub(" ", sem) if "\\" in sem else sem)
    return filter(None, map(_PROSE.__getitem__, words))


def _meaning(sem: str) -> filter:
    if "\\" in sem:
        sem = _ROOT.sub(r" sqrt \1 ", _FRACTION.sub(r" frac \1 \2 ", sem))
    return filter(None, map(_MEANING.__getitem__, _WORDS.findall(sem)))


_STOP = frozenset(STOPWORDS)
_PROSE, _MEANING = _Kept(3), _Kept(2)


@F.pandas_udf(T.StructType([T.StructField("prose", T.StringType()), T.StructField("meaning", T.StringType())]))
def _kept_words(c: pd.Series) -> pd.DataFrame:
    """Stems of a rewritten text's words of three letters and a meaning, and of its words of two signs, joined by blanks.

    Both come from one pass: regular expressions on each occurrence of a word, and rewriting a text for each of the
    two, cost more than the way through Arrow.
    """
    texts = [t or "" for t in c]
    return pd.DataFrame({"prose": [" ".join(_prose(t)) for t in texts], "meaning": [" ".join(_meaning(t)) for t in texts]})


def _split_words(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def word_tokens(sem: Column) -> Column:
    """struct<prose, meaning> of a rewritten text; the parts are split by :func:`prose_tokens` and :func:`semantic_tokens`."""
    return _kept_words(sem)


def prose_tokens(words: Column) -> Column:
    return let(words["prose"], _split_words)


def semantic_tokens(words: Column) -> Column:
    return let(words["meaning"], _split_words)


def literal_tokens(canon: Column) -> Column:
    c = sub_where(sub_where(canon, "\\frac", FRACTION, r" $1 / $2 "), "\\sqrt", ROOT, " sqrt $1 ")
    return F.filter(F.split(sub(c, r"(?iu)[^a-zäöüß0-9.,=+*/:^_<>-]+", " "), " "), lambda w: w != "")  # white space is one blank by now


def _points(items: Column) -> Column:
    return F.transform(items, lambda n: F.replace(n, F.lit(","), F.lit(".")))


def number_tokens(canon: Column) -> Column:
    return _points(found(canon, NUMBER))


def math_tokens(canon: Column) -> Column:
    c = sub(sub(sub(canon, r"\\frac", " frac "), r"\\sqrt", " sqrt "), r"\\mathbb\{([^}]+)\}", r" mathbb_$1 ")
    return _points(found(c, MATH))


def part_count(c: Column) -> Column:
    return F.size(F.array_distinct(F.transform(found(text(c), PART, 1), F.lower)))


_MIX = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15)]


def numbered(t: str) -> np.ndarray:
    """The trigrams of a text, each with its occurrence number, as 64-bit digests."""
    code = np.frombuffer(f"  {t}  ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    gram = np.sort(code[:-2] << np.uint64(42) | code[1:-1] << np.uint64(21) | code[2:])
    at = np.arange(len(gram))
    start = np.maximum.accumulate(np.where(np.concatenate([[True], gram[1:] != gram[:-1]]), at, 0))
    h = gram * _MIX[0] ^ (at - start).astype(np.uint64) * _MIX[2]
    for m in _MIX[:2]:
        h = (h ^ h >> np.uint64(33)) * m
    return (h ^ h >> np.uint64(33)).view(np.int64)


#: Characters of texts whose trigrams a worker holds at once (a longer text alone).
TRIGRAMS_OF = 1 << 19
#: Characters of texts whose features, many times as much, a join may send through the driver.
FEATURES_OF = 1 << 20


def pieces(c: pd.Series, most: int) -> Iterator[pd.Series]:
    """A column of texts in runs of ``most`` characters, a longer text alone."""
    begin = held = 0
    for i, t in enumerate(c):
        n = len(t or "")
        if i > begin and held + n > most:
            yield c.iloc[begin:i]
            begin, held = i, 0
        held += n
    yield c.iloc[begin:]


@F.pandas_udf(T.ArrayType(T.LongType()))
def trigrams(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Character trigrams of a text with two blanks at both ends, each with its occurrence number, as 64-bit digests.

    With the numbers a multiset is a set, so two are compared by hashing and not all with all. Digests are eight times
    their text and more, so a batch of rows is answered piece by piece.
    """
    for c in columns:
        for piece in pieces(c, TRIGRAMS_OF):
            yield piece.map(lambda t: numbered(t or ""))


def features(rows: DataFrame, body: str, title: str | None = None, normal: bool = True) -> DataFrame:
    """``rows`` with a struct ``f`` of all that the score needs, computed once a text."""
    canon = rows.withColumn("__c", canonical(F.col(body), normal)).withColumn("__t", canonical(F.col(title), normal) if title else F.lit(""))
    sem = canon.withColumn("__s", semantic(F.col("__c"))).withColumn("__u", semantic(F.col("__t")))
    sem = sem.withColumn("__w", word_tokens(F.col("__s"))).withColumn("__v", word_tokens(F.col("__u")))
    f = F.struct(
        F.col("__c").alias("canon"),
        prose_tokens(F.col("__w")).alias("prose"),
        semantic_tokens(F.col("__w")).alias("semantic"),
        literal_tokens(F.col("__c")).alias("literal"),
        trigrams(F.col("__c")).alias("chars"),
        trigrams(structural(F.col("__s"))).alias("structure"),
        math_tokens(F.col("__c")).alias("math"),
        number_tokens(F.col("__c")).alias("numbers"),
        part_count(F.col(body)).alias("parts"),
        (text(F.col(title)) if title else F.lit("")).alias("title"),
        prose_tokens(F.col("__v")).alias("title_prose"),
        trigrams(F.col("__t")).alias("title_chars"),
    )
    return sem.withColumn("f", f).drop("__c", "__t", "__s", "__u", "__w", "__v")


#: Signals that compare sets of tokens, and those that compare multisets of trigrams.
TOKEN_SETS, TRIGRAM_SETS = ["prose", "semantic", "literal", "math", "numbers"], ["chars", "structure"]


def _measures(f: Column) -> Column:
    """Sizes of a text's features, by which the score is bounded."""
    return F.struct(
        *[F.size(F.array_distinct(f[k])).alias(k) for k in TOKEN_SETS],
        *[F.size(f[k]).alias(k) for k in TRIGRAM_SETS],
        F.size(f["prose"]).alias("all_prose"),
        F.size(f["numbers"]).alias("all_numbers"),
        F.length(f["canon"]).alias("length"),
        f["parts"].alias("parts"),
        (f["title"] != "").alias("titled"),
    )


def _signals(a: Column, b: Column) -> dict[str, Column]:
    some = lambda k: (F.size(a[k]) > 0) & (F.size(b[k]) > 0)
    title = 0.65 * jaccard(a["title_prose"], b["title_prose"]) + 0.35 * dice(a["title_chars"], b["title_chars"])
    return {
        "prose": F.when((F.size(a["prose"]) == 0) & (F.size(b["prose"]) == 0), F.lit(0.35)).otherwise(jaccard(a["prose"], b["prose"])),
        "semantic": jaccard(a["semantic"], b["semantic"]),
        "literal": jaccard(a["literal"], b["literal"]),
        "chars": dice(a["chars"], b["chars"]),
        "structure": dice(a["structure"], b["structure"]),
        "math": F.when(some("math"), jaccard(a["math"], b["math"])).otherwise(F.lit(0.45)),
        "title": F.when((a["title"] == "") & (b["title"] == ""), F.lit(0.45)).otherwise(title),
        "numbers": F.when(some("numbers"), jaccard(a["numbers"], b["numbers"])).otherwise(F.lit(0.45)),
    }


def _most_signals(x: Column, y: Column) -> dict[str, Column]:
    """What the signals of texts of these sizes are at most."""

    def sets(k: str) -> Column:
        return F.when((x[k] == 0) & (y[k] == 0), F.lit(1.0)).otherwise(F.least(x[k], y[k]) / F.greatest(x[k], y[k], F.lit(1)))

    def trigram_sets(k: str) -> Column:
        return 2 * F.least(x[k], y[k]) / (x[k] + y[k])

    out = {k: sets(k) for k in ("prose", "semantic", "literal")} | {k: trigram_sets(k) for k in TRIGRAM_SETS}
    out |= {k: F.when((x[k] > 0) & (y[k] > 0), sets(k)).otherwise(F.lit(0.45)) for k in ("math", "numbers")}
    return out | {"title": F.when(x["titled"] | y["titled"], F.lit(1.0)).otherwise(F.lit(0.45))}


# Conditions on signals that raise the score, as (least signals, least prose words, base, weights).
RAISES = [
    ({"semantic": 0.58, "prose": 0.42}, 0, 0.52, {"semantic": 0.18, "prose": 0.08}),
    ({"semantic": 0.72, "structure": 0.68}, 0, 0.66, {"semantic": 0.16}),
    ({"prose": 0.84, "structure": 0.78}, 3, 0.76, {"literal": 0.10}),
]
# Factors for few common numbers, unlike numbers of sub-tasks, unlike lengths, and few words.
NUMBERS_FACTOR, PARTS_FACTOR, LENGTH_FACTORS, WORDS_FACTOR = 0.84, 0.88, [(0.42, 0.78), (0.58, 0.88)], 0.72
NUMBERS_BELOW, PARTS_APART, WORDS_BELOW = {"numbers": 0.20, "prose": 0.68, "semantic": 0.68}, 2, {"semantic": 0.65, "literal": 0.72}


def _combined(s: dict[str, Column], x: Column, y: Column) -> Column:
    """The score of signals and sizes. It never falls when a signal rises, so signals at their most give a bound."""
    weighted = lambda ws: sum((w * s[k] for k, w in ws.items()), F.lit(0.0))
    many = lambda k, n: (x[f"all_{k}"] >= n) & (y[f"all_{k}"] >= n)
    below = lambda limits: reduce(and_, (s[k] < v for k, v in limits.items()))
    raised = [F.when(reduce(and_, (s[k] >= v for k, v in least.items()), many("prose", words)), base + weighted(ws)) for least, words, base, ws in RAISES]
    score = F.greatest(weighted(WEIGHTS), *raised)  # nulls do not count
    ratio = F.least(x["length"], y["length"]) / F.greatest(x["length"], y["length"], F.lit(1))
    few = (x["all_prose"] <= 1) & (y["all_prose"] <= 1)
    by_length = F.when(ratio < LENGTH_FACTORS[0][0], LENGTH_FACTORS[0][1]).when(ratio < LENGTH_FACTORS[1][0], LENGTH_FACTORS[1][1])
    damp = F.when(many("numbers", 2) & below(NUMBERS_BELOW), NUMBERS_FACTOR).otherwise(1.0) * by_length.otherwise(1.0)
    damp = damp * F.when((x["parts"] > 0) & (y["parts"] > 0) & (F.abs(x["parts"] - y["parts"]) >= PARTS_APART), PARTS_FACTOR).otherwise(1.0)
    damp = damp * F.when(few & below(WORDS_BELOW), WORDS_FACTOR).otherwise(1.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score * damp))


def with_score(pairs: DataFrame, a: str = "fa", b: str = "fb", out: str = "score") -> DataFrame:
    """Pairs of feature structs with their similarity in 0 to 1; the signals are computed once."""
    ca, cb = F.col(a), F.col(b)
    rows = pairs.withColumn("__g", F.struct(*[c.alias(k) for k, c in _signals(ca, cb).items()])).withColumn("__x", _measures(ca)).withColumn("__y", _measures(cb))
    final = _combined({k: F.col(f"__g.{k}") for k in WEIGHTS}, F.col("__x"), F.col("__y"))
    empty = (ca["canon"] == "") | (cb["canon"] == "")
    return rows.withColumn(out, F.when(empty, F.lit(0.0)).when(ca["canon"] == cb["canon"], F.lit(1.0)).otherwise(final)).drop("__g", "__x", "__y")


#: Signals by one of which two texts have to be alike, and what the others give at most where nothing is known of the partner.
KINDS = ["prose", "semantic", "literal"]


def _least_alike(z: Column) -> Column:
    """The similarity that one of the three kinds of tokens has to have with any text that scores ``COLLECT`` or more.

    The other signals give no more than their weights; without numbers or mathematics of its own a text gets 0.45 for them.
    The raises ask for more than this of a kind, and the factors only lower a score.
    """
    rest = sum(WEIGHTS[k] for k in (*TRIGRAM_SETS, "title"))
    rest = F.lit(rest) + F.when(z["math"] > 0, WEIGHTS["math"]).otherwise(0.45 * WEIGHTS["math"]) + F.when(z["numbers"] > 0, WEIGHTS["numbers"]).otherwise(0.45 * WEIGHTS["numbers"])
    return (COLLECT - rest) / sum(WEIGHTS[k] for k in KINDS) - setjoin.SLACK


def topic_order(preferred: Column, topics: Column, related: Column | None = None) -> Column:
    """Topics of a class as they are visited: the preferred, its related ones, the others in order."""
    front = F.array(preferred) if related is None else F.concat(F.array(preferred), related)
    return F.filter(F.array_distinct(F.concat(front, topics)), lambda t: F.array_contains(topics, t))


def related_topics(preferred: Column) -> Column:
    known = F.create_map(*[x for k, v in RELATED_TOPICS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(known, preferred), F.array().cast("array<string>"))


def class_topics(level: Column, by_class: dict[str, list[str]] = TOPICS_BY_CLASS) -> Column:
    known = F.create_map(*[x for k, v in by_class.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    return F.coalesce(F.try_element_at(known, level), F.array().cast("array<string>"))


def _token_sets(rows: DataFrame, key: str, *keep: str) -> DataFrame:
    """(key, kind, tokens, least, *keep) of featured rows, tokens as digests; a kind without tokens has an empty one, so that it meets its like."""

    def digests(k: str) -> Column:
        own = F.array_distinct(F.col("f")[k])
        return F.transform(F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(""))), lambda t: F.xxhash64(F.lit(k), t))

    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), digests(k).alias("tokens")) for k in KINDS])
    own = rows.where(F.length("f.canon") > 0).select(F.col(key).alias("key"), *keep, _least_alike(F.col("z")).alias("least"), F.inline(kinds))
    return own.select("key", "kind", *keep, "least", "tokens")


def _pool_index(theirs: DataFrame, rarity: DataFrame) -> DataFrame:
    """(key, kind, class_level, topic, z, n, least, before, tokens): of each set the tokens that drafts have, by the order of ``rarity``.

    Tokens of no draft come first in the order: ``before`` are so many. They meet nothing, so they are counted and not kept,
    and of the others only those that :func:`setjoin.index` would keep. Sets of which none is left are not there.
    """
    rows = theirs.select("key", "kind", "class_level", "topic", "z", "least", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(rarity, "token")
    own = rows.groupBy("key", "kind").agg(*[F.first(c).alias(c) for c in ("class_level", "topic", "z", "least", "n")], F.sort_array(F.collect_set(F.struct("f", "token"))).alias("tokens"))
    own = own.withColumn("before", F.col("n") - F.size("tokens"))
    kept = (F.floor(F.col("n") * (1 - F.col("least")) + setjoin.SLACK) + 1 - F.col("before")).cast("int")
    return own.where(kept > 0).withColumn("tokens", F.slice("tokens", 1, kept)["token"])


def candidates(drafts: DataFrame, pool: DataFrame, normal: bool = True, counts: list[tuple[int, int]] | None = None) -> DataFrame:
    """Scored pairs (draft_id, task_id, topic_rank, scan_ord, score) of 0.46 or more that a draft's visit comes to.

    drafts: draft_id, title, question_text, class_level, topics (in visiting order). pool: task_id, title, question_text,
    class_level, topic, scan_ord. Topics after one that brings the running best to 0.84 are not visited; of a task's
    several rows the first visited counts. Drafts go through their topics in rounds of one topic, two, four and so on;
    a round forms pairs of the drafts that are still below 0.84 and the tasks of its topics. A pair is scored only if it
    shares one of the rarest tokens of its prose, meaning or literal words and the sizes allow the score; all others are
    below 0.46. counts: gets (first rank, scored pairs) of each round.
    """
    spark = drafts.sparkSession
    some = spread(drafts.where("class_level is not null and class_level <> ''").select("draft_id", "title", "question_text", "class_level", "topics"))
    left = scratch.written(features(some, "question_text", "title", normal).select("draft_id", "class_level", "topics", "f", _measures(F.col("f")).alias("z")), "drafts")
    tasks = pool.select("task_id", "title", "question_text", "class_level", "topic", "scan_ord").withColumn("row", F.xxhash64("task_id", "topic", "scan_ord", "class_level", "title", "question_text"))
    # features of the pool are many times its texts: they are not written, but worked out once for the index and again for the few that are scored
    own = _token_sets(left, "draft_id")
    rarity = scratch.written(setjoin.counted(own), "rarity")
    own = scratch.written(setjoin.index(own, rarity, "kind"), "index")
    theirs = features(spread(tasks), "question_text", "title", normal).withColumn("z", _measures(F.col("f")))
    theirs = scratch.written(_pool_index(_token_sets(theirs, "row", "class_level", "topic", "z"), rarity), "index")
    met_by = theirs.select("key", "kind", "class_level", "topic", "n", "least", "before", F.posexplode("tokens").alias("i", "token")).withColumn("i", F.col("i") + F.col("before"))
    # rows of drafts that say the same are one key: a small index of the pool goes to them
    if (theirs.agg(F.sum(F.size("tokens"))).first()[0] or 0) <= FEW:
        met_by = F.broadcast(met_by)
    right = theirs.select(F.col("key").alias("row"), F.col("z").alias("zb")).distinct()
    # tasks with several rows: those that the draft visits before come first
    again = tasks.groupBy("class_level", "task_id").agg(F.count("*").alias("n"), F.collect_list(F.struct("topic", "scan_ord", "row")).alias("rows")).where("n > 1").select("class_level", "task_id", "rows")
    most = left.agg(F.max(F.size("topics"))).first()[0] or 0
    rounds: list[str] = []
    plain = left.select("draft_id", "class_level", "topics")
    # a table's bytes on disk say little of its rows, so drafts are never sent through the driver on their account
    sizes = left.select("draft_id", F.col("z").alias("za")).hint("merge")
    first = 0
    while first < most:
        until = min(most, 2 * first + 1)
        active = plain
        if rounds:
            strong = spark.read.parquet(*rounds).where(F.col("score") >= STOP_AT).select("draft_id").distinct()
            active = active.join(strong.hint("merge"), "draft_id", "left_anti")
        turn = active.select(F.col("draft_id").alias("key"), "class_level", F.explode(F.slice("topics", first + 1, until - first)).alias("topic"))
        # written, so that its size is known: a few drafts do not shuffle the index of the pool
        turn = scratch.written(own.join(turn.hint("merge"), "key"), "turn")
        met = setjoin.meetings(turn, met_by, "kind", "class_level", "topic").select(F.col("a").alias("draft_id"), F.col("b").alias("row")).distinct()
        sized = met.join(sizes, "draft_id").join(right, "row")
        near = sized.where(_combined(_most_signals(F.col("za"), F.col("zb")), F.col("za"), F.col("zb")) >= COLLECT - setjoin.SLACK)
        # written, so that its size is known when it meets the features: few pairs do not shuffle those of the whole pool
        near = scratch.written(near.select("draft_id", "row"), "pairs")
        a = left.select("draft_id", "topics", F.col("f").alias("fa"))
        some = scratch.written(tasks.join(near.select("row").distinct(), "row", "left_semi"), "tasks")
        b = features(spread(some), "question_text", "title", normal).select("row", "task_id", "class_level", "topic", "scan_ord", F.col("f").alias("fb"))
        chars = some.agg(F.sum(F.length(text("question_text")) + F.length(text("title")))).first()[0] or 0
        b = F.broadcast(b) if chars <= FEATURES_OF else b.hint("merge")  # the size that Spark guesses for features is that of their texts
        pairs = by_rows(near).join(a, "draft_id").join(b, "row")
        place = lambda topic, *rest: F.struct(F.array_position("topics", topic), *rest)
        here = place(F.col("topic"), "scan_ord", "row")
        earlier = F.exists("rows", lambda o: F.array_contains("topics", o["topic"]) & (place(o["topic"], o["scan_ord"].alias("scan_ord"), o["row"].alias("row")) < here))
        pairs = pairs.join(again, ["class_level", "task_id"], "left").where(~F.coalesce(earlier, F.lit(False)))
        scored = with_score(pairs).select("draft_id", "task_id", (F.array_position("topics", F.col("topic")) - 1).cast("int").alias("topic_rank"), "scan_ord", "score")
        done = scratch.written(scored, "scored")
        rounds.append(done.scratch)
        scratch.discard(near, some, turn)
        if counts is not None:
            counts.append((first, done.count()))
        first = until
    scratch.discard(rarity, own, theirs)
    schema = f"draft_id {dict(left.dtypes)['draft_id']}, task_id {dict(tasks.dtypes)['task_id']}, topic_rank int, scan_ord {dict(tasks.dtypes)['scan_ord']}, score double"
    out = spark.read.schema(schema).parquet(*rounds) if rounds else spark.createDataFrame([], schema)
    best = F.max("score").over(Window.partitionBy("draft_id").orderBy("topic_rank").rangeBetween(Window.unboundedPreceding, -1))  # a draft's candidates
    return out.where(F.col("score") >= COLLECT).withColumn("before", F.coalesce(best, F.lit(0.0))).where(F.col("before") < STOP_AT).drop("before")


def top_duplicates(pairs: DataFrame, most: int = MOST) -> DataFrame:
    """(draft_id, rank, task_id, score): up to ``most`` candidates of 0.50 or more, best first."""
    order = Window.partitionBy("draft_id").orderBy(F.desc("score"), "topic_rank", "scan_ord", "task_id")
    return pairs.where(F.col("score") >= SHOW).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("draft_id", "rank", "task_id", "score")


def add_duplicates(drafts: DataFrame, pool: DataFrame, normal: bool = True) -> DataFrame:
    """Drafts with ``duplicates`` (best first), ``duplicate``, and ``include`` off for virtual copies."""
    top = top_duplicates(candidates(drafts, pool, normal)).join(pool.select("task_id", F.col("title").alias("task_title"), "topic"), "task_id")
    listed = top.groupBy("draft_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("task_id").alias("id"), F.col("task_title").alias("title"), "topic", "score"))).alias("duplicates"))
    out = drafts.join(listed.hint("merge"), "draft_id", "left").withColumn("duplicate", F.get("duplicates", F.lit(0)))
    return out.withColumn("include", F.col("include") & (F.coalesce("duplicate.score", F.lit(0.0)) < DESELECT))
