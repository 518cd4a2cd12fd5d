"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item's *windows* are its runs of ``window`` consecutive words (the whole item if it has fewer words). A
window is seen as the set of its shingles, of one word each here. A document contains a window only if it
contains all of them, so the overlap that is asked for equals the set's size, and the necessary prefix of the
set, in order of rarity over the documents, is its rarest shingle: its anchor.

1. The benchmark's words are counted over all documents. A window with a word that no document has is out.
2. Documents meet the anchors alone. An anchor's place in document and window fixes where the window would
   start (positional bound: not before the document's first word) and end (length bound: not past its last).
3. What is left is verified exactly, over the item-sized window: the words at that place are the window's.

The benchmark goes to the executors in blocks of bounded bytes, one pass over the documents for each block, so
texts are never shuffled and nothing that is broadcast grows with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, discard, fresh, materialize

#: Bytes of benchmark words or windows that are broadcast at a time, at most.
BROADCAST_BYTES = 32 << 20
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OTHER_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The lower-cased words of a text in order; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _OTHER), "")


def word_count(text: Column) -> Column:
    """The number of words of a text, by the blanks between them."""
    norm = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _OTHER_ANY_CASE, " "))
    return F.when(norm == "", F.lit(0)).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1).cast("long")


def digest(text_col: str) -> Column:
    return F.struct(F.xxhash64(text_col, F.lit(0)).alias("d0"), F.xxhash64(text_col, F.lit(1), F.lit(2)).alias("d1"))


def windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(wid, len, win) of the distinct windows, and (wid, item)."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where("item is not null and size(w) > 0")
    cut = items.select("item", "w", F.least(F.size("w"), F.lit(window)).alias("len"))
    cut = cut.select("item", "len", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))).alias("at"))
    cut = cut.select("item", "len", F.array_join(F.slice("w", F.col("at") + 1, F.col("len")), " ").alias("win")).distinct()
    # equal windows have equal texts, so the text's digest names them
    cut = materialize(cut.withColumn("wid", F.sha2("win", 256)), "windows")
    return cut.select("wid", "len", "win").distinct(), cut.select("wid", "item").distinct()


def blocks(rows: DataFrame, key: str, size: Column, most_bytes: int) -> list[DataFrame]:
    """``rows`` in parts of about ``most_bytes``, by digests of ``key``; each is read when it is broadcast."""
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first().b
    n = max(1, -(-total // most_bytes))
    return [rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) if n > 1 else rows for i in range(n)]


def rarity(docs: DataFrame, vocabulary: DataFrame, most_bytes: int) -> DataFrame:
    """(word, df): occurrences in all documents of the words of ``vocabulary`` that have any."""
    word = docs.select(F.explode("words").alias("word"))
    parts = [word.join(F.broadcast(v), "word").groupBy("word").agg(F.count("*").alias("df")) for v in blocks(vocabulary, "word", F.octet_length("word") + 48, most_bytes)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def occurrences(docs: DataFrame, benchmark: DataFrame, item_col: str, bench_text: str, window: int, most_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(id, digest, wid, start, len) of every window in every document text, and (wid, item).

    docs: (id, digest, words).
    """
    spelled, owners = windows(benchmark, item_col, bench_text, window)
    placed = spelled.select("wid", F.posexplode(F.split("win", " ")).alias("off", "word"))
    vocabulary = materialize(placed.select("word").distinct(), "vocabulary")
    counts = materialize(rarity(docs, vocabulary, most_bytes), "rarity")
    ranked = placed.join(counts, "word", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "off")).alias("p"))
    anchors = spelled.join(ranked.where("p.df > 0"), "wid").select("wid", "len", "win", F.col("p.word").alias("word"), F.col("p.off").alias("off"))
    anchors = materialize(anchors, "anchors")
    own = docs.select("id", "digest", "words", F.posexplode("words").alias("pos", "word"))
    start = F.col("pos") - F.col("off")
    found = None
    for part in blocks(anchors, "word", F.octet_length("win") + F.octet_length("word") + 160, most_bytes):
        met = own.join(F.broadcast(part), "word").where((start >= 0) & (start + F.col("len") <= F.size("words")))
        met = met.where(F.array_join(F.slice("words", start + 1, F.col("len")), " ") == F.col("win")).select("id", "digest", "wid", start.alias("start"), "len")
        found = met if found is None else found.unionByName(met)
    found = materialize(found, "occurrences")
    discard(vocabulary, counts, anchors)
    return found, owners


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    bench_text: str = "text",
    window: int = 13,
    share: int = 20,
    most_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(id, digest, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    A word is hit if an occurrence of a window of any item covers it; a document is contaminated if
    words are hit and ``share`` times their number reaches its word count. Null and empty texts have
    no words and no hits. Items with a null id or no words are left out; repeated items count once
    for each distinct id. Rows equal in id and text get equal results, once each. A text's length is not
    limited; empty tables give no rows, or no hits; other columns of both tables are not read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), digest(text_col).alias("digest"), F.col(text_col).alias("text"))
    met, owners = occurrences(own.select("id", "digest", words_of(F.col("text")).alias("words")), benchmark, item_col, bench_text, window, most_bytes)
    # hit words: length of the union of the intervals
    doc = Window.partitionBy("id", "digest").orderBy("start", "len")
    before = F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    spans = met.groupBy("id", "digest", "start").agg(F.max("len").alias("len")).withColumn("end", F.col("start") + F.col("len"))
    hits = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))))).groupBy("id", "digest").agg(F.sum("new").alias("n_hit"))
    # items: windows with the same owners are one class; documents with the same classes share a digest
    classes = owners.groupBy("wid").agg(F.sort_array(F.collect_set("item")).alias("items"))  # of the benchmark, not of documents
    classes = materialize(classes.withColumn("cls", F.sha2(F.array_join("items", "\x00"), 256)), "classes")
    sets = met.select("id", "digest", "wid").distinct().join(classes.select("wid", "cls"), "wid").groupBy("id", "digest").agg(F.sort_array(F.collect_set("cls")).alias("set"))
    hits = hits.alias("h").join(sets.alias("s"), F.col("h.id").eqNullSafe(F.col("s.id")) & (F.col("h.digest") == F.col("s.digest"))).select("h.id", "h.digest", "n_hit", "set")
    sums = materialize(hits, "hits")
    owned = classes.select("cls", "items").dropDuplicates(["cls"])
    listed = sums.select("set").distinct().select("set", F.explode("set").alias("cls")).join(owned, "cls").select("set", F.explode("items").alias("item")).distinct()
    listed = listed.groupBy("set").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    hits = materialize(sums.join(listed, "set").select("id", "digest", "n_hit", "n_items", "items_sha256"), "judged")
    discard(sums)
    discard(met, classes)
    a, b = own.select("id", "digest", word_count(F.col("text")).alias("n")).alias("a"), hits.alias("b")
    both = a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.digest") == F.col("b.digest")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return both.select(
        F.col("a.id").alias("id"),
        F.col("a.digest").alias("digest"),
        F.col("n").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (F.lit(share) * n_hit >= F.col("n"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated ones; all columns stay as they are, whatever their names."""
    key_id, key, own = fresh(docs, "id", "key", "digest")
    bad = contamination(docs, benchmark, id_col, text_col, **options).where("contaminated")
    bad = materialize(bad.select(F.col("id").alias(key_id), F.col("digest").alias(key)).distinct(), "contaminated").hint("shuffle_hash")
    rows = docs.withColumn(own, digest(text_col))
    return rows.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col(key_id)) & (F.col(own) == F.col(key)), "left_anti").select(*docs.columns)


def op4_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = contamination(docs, benchmark)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item, w, least(len(w), 13) AS k, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS p FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM bw),
ks AS (SELECT DISTINCT k FROM win),
dp AS (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM d, ks WHERE len(w) >= k),
ds AS (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM dp),
occ AS (SELECT ds.r, ds.k, ds.p, win.item FROM ds JOIN win ON ds.k = win.k AND ds.s = win.s),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + k - 1)) AS q FROM (SELECT DISTINCT r, k, p FROM occ)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(d.w), 0) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
