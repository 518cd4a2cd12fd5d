"""The corpus pipeline against a plain version of its five stages, and its edge cases."""

import random
import re

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe
from test_dedup_ops import five_words, plain_repeats, union

import corpus_pipeline
from taskloom.llm import suffix_dedup, toxicity

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TOXIC = ["scheusal", "trottelhaft", "v3rdammt"]


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_contaminated(text, items):
    words = plain_words(text)
    windows = set()
    for item in items:
        w = plain_words(item)
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    hit = set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(words)


def corpus(seed=4):
    rng = random.Random(seed)
    vocab = [f"wort{i}" for i in range(900)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs, toxic, items = [], {}, [" ".join(text(40)) for _ in range(4)] + ["kurz und gut"]
    passages = [text(rng.randint(52, 70)) for _ in range(4)]
    for i in range(420):
        w = text(rng.randint(60, 110))
        kind = i % 12
        if kind in (0, 1, 2):
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(TOXIC))
        elif kind == 3 and i > 100:
            w = docs[i - 52][1].split()  # an exact copy
        elif kind == 4 and i > 100:
            w = docs[i - 53][1].split()
            w[rng.randrange(len(w))] = "neu"  # a near copy
        elif kind in (5, 6):
            p = rng.choice(passages)
            w = w[:30] + p + w[30:]
        elif kind == 7:
            b = rng.choice(items[:4]).split()
            w = w[:20] + b[: rng.randint(13, 40)] + w[20:]
        docs.append((i, " ".join(w)))
        toxic[i] = int(kind in (0, 1, 2))
    docs += [(500, None), (501, ""), (502, " \n"), (None, "nur hier " + " ".join(text(20))), (503, "kurz UND gut"), (504, docs[9][1])]
    return docs, toxic, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, toxic, items = corpus()
    path = str(tmp_path_factory.mktemp("sf"))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    names = ["toxicity", "_toxicity", "__toxicity", "__digest", "_digest", "_key", "_id", "id", "digest", "component", "start", "words"]
    rows = rows.withColumns({"lang": F.lit("de"), "source": F.lit(None).cast("string"), **{n: F.lit(n) for n in names}, "token_ids": F.lit("x")})
    rows.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_equals_plain_version(spark, folder):
    docs, toxic, items = corpus()
    table = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit_documents(table, spark.read.parquet(f"{folder}/labels.parquet"))
    # toxicity: the learned scores decide, and they catch what is planted
    bad = model.scores([(t or "").encode() for _, t in docs]) >= 0.5
    planted = [bool(toxic.get(i, 0)) for i, _ in docs]
    assert all(b for b, t in zip(bad, planted) if t) and sum(b and not t for b, t in zip(bad, planted)) <= 0.03 * len(docs)
    kept = [d for d, b in zip(docs, bad) if not b]
    # near copies: groups of exact five-word similarity
    sets = [five_words(t or "") for _, t in kept]
    links = [(i, j) for i in range(len(kept)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    group = union(len(kept), links)
    place = lambda d: (d[0] is None, d[0] or 0)
    least = {}
    for g, d in zip(group, kept):
        least[g] = min(least.get(g, d), d, key=place)
    kept = [d for g, d in zip(group, kept) if least[g] is d]
    assert len(kept) < len(sets)
    # repeated passages: words of later occurrences go
    later = {}
    for i, w, first in plain_repeats(kept, 50):
        if not first:
            later.setdefault(i, set()).add(w)
    assert later
    cut = []
    for i, t in kept:
        if i in later:
            t = suffix_dedup.cut_words(t, [(w, w + 1) for w in sorted(later[i])])
            if not t.split():
                continue
        cut.append((i, t))
    # contamination
    clean = [(i, t) for i, t in cut if not plain_contaminated(t, items)]
    assert len(clean) < len(cut) and (503, "kurz UND gut") not in clean
    # token ids
    ranks = load_tiktoken_bpe(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {(i, t): library.encode_ordinary(t or "") for i, t in clean}
    out = corpus_pipeline.run(spark, folder)
    rows = out.collect()
    assert {(r.doc_id, r.text): list(r.token_ids) for r in rows} == want and len(rows) == len(want) and all(r.round_trip for r in rows)
    own = [c for c in table.columns if c != "token_ids"]
    assert out.columns == [*own, "token_ids", "round_trip"]
    assert all(r[c] == c for r in rows for c in own if c not in ("doc_id", "text", "lang", "source"))


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_stages_of_repeated_and_long_rows(spark, folder):
    long = "wort " * 60000
    rows = [(3, long), (3, long), (4, "ein zwei drei"), (4, "ein zwei drei"), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit(None).cast("int"))
    kept = {name: stage(spark, docs, folder).collect() for name, stage in corpus_pipeline.STAGES}
    assert len(kept["toxicity"]) == len(kept["decontaminate"]) == len(kept["bpe"]) == 6
    assert sorted((r.doc_id or 0, r.text or "") for r in kept["near_copies"]) == [(0, ""), (3, long), (4, "ein zwei drei")]
    # repeated rows are one document, whose text repeats itself within its first occurrence
    texts = {r.doc_id: r.text for r in kept["suffix_dedup"]}
    assert len(kept["suffix_dedup"]) == 6 and texts[4] == "ein zwei drei" and set(texts[3].split()) == {"wort"} and len(texts[3].split()) <= 100
