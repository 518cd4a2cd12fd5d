"""Near copies by the exact Jaccard similarity of five-word shingle sets, for the corpus pipeline.

Groups begin with the links of operator 6: SimHash fingerprints over five-word shingles, joined by the vantage-point
forest at ``RADIUS`` bits and confirmed by the whole sets. Pairs at 0.8 can lie farther apart than any radius that
a forest can prune at, so the other links' candidates come from min-hash bands: ``BANDS`` bands of ``ROWS`` minima, so a pair of similarity s shares
no band with probability (1 - s^5)^32, which is 3e-6 at 0.8. Every link is confirmed by the sets themselves.
Texts of equal sets are one node. In a few turns, each bucket that holds several groups compares one centre
with its members, which gives as many pairs as members and joins large groups of copies quickly. The nodes of
buckets that stay mixed then meet by an exact prefix filter: of two sets of different groups only those are
compared that share a shingle among their rarest fifth and have enough left behind it, so large groups of
texts that are alike but not alike enough give few pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import discard, look_up, materialize, slices
from .components import components

SHINGLE = 5
#: Differing bits up to which fingerprints give candidates.
RADIUS = 3
#: Turns in which a bucket's centre meets its members, before what stays apart is compared by rare shingles.
TURNS = 4
#: Rows of sets and of pairs of sets that a worker takes at a time: sets are eight bytes for each word of a text.
SET_ROWS, PAIR_ROWS = 256, 128
BANDS, ROWS = 32, 5
SEED = 42
_rng = np.random.default_rng(SEED)
_FACTOR = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit digests of the five-word shingles; of all words where there are fewer than five."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    k = min(SHINGLE, len(words))
    if not k:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(flat[i:j], SEED) for i, j in zip((end - size)[:n].tolist(), end[k - 1 :].tolist())), np.uint64, n))


def buckets(own: np.ndarray) -> list[int]:
    """A signed key for each band; none for an empty set."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 256):  # pieces that stay in the processor's cache
        part = _FACTOR[:, None] * own[None, at : at + 256] + _SHIFT[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    least = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(least[i].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64).tolist()


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = [shingles(t) for t in b.column(2).to_pylist()]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        n = pa.array([len(s) for s in sets], pa.int64())
        fp = pa.array([simhash.fingerprint(t, SHINGLE) for t in b.column(2).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), n, fp, pa.array([buckets(s) for s in sets], pa.list_(pa.int64()))], ["id", "digest", "node", "n", "fp", "buckets"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["node", "shingles"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        hit = []
        for x, y in zip(b.column(2), b.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            common = len(np.intersect1d(x, y, assume_unique=True))
            hit.append(5 * common >= 4 * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))


def _near(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can have a similarity of 0.8."""
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets have a similarity of 0.8 or more."""
    x, y = sets.toDF("a", "x"), sets.toDF("b", "y")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_confirmed, "a long, b long")


def _grouped(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """``rows`` with ``g``, the group of their node; a node that is in none is its own."""
    if groups is None:
        return rows.withColumn("g", F.col("node"))
    return rows.join(groups, "node", "left").withColumn("g", F.coalesce("component", "node")).drop("component")


def _mixed(rows: DataFrame, key: str, *first: Column) -> DataFrame:
    """(key, *first) of the keys whose rows belong to several groups."""
    return rows.groupBy(key).agg(F.min("g").alias("l"), F.max("g").alias("h"), *first).where("l != h").drop("l", "h")


def star_pairs(rows: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) of each bucket's centre in this turn and its members of other groups, and the members of mixed buckets.

    A bucket has as many pairs as members. rows: (bucket, node, n, g).
    """
    centre = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "g")).alias("centre")
    member = materialize(rows.join(_mixed(rows, "bucket", centre), "bucket"), "members")
    apart = member.where((F.col("g") != F.col("centre.g")) & _near(F.col("n"), F.col("centre.n")))
    return apart.select(F.col("centre.node").alias("a"), F.col("node").alias("b")).distinct(), member


def prefix_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes (node, n, g) of different groups that can have a similarity of 0.8, none left out.

    Sets are ordered by rarity, which is the number of groups that have a shingle: those of one group alone come
    first and join no groups. Two sets that are similar enough share one of the first n - 0.8 n + 1 shingles of
    each, and the first one they share leaves enough behind it in both.
    """
    own = nodes.join(sets, "node").mapInArrow(_exploded, "token long, node long, n long, g long")
    own = materialize(own, "tokens", SET_ROWS)
    rarity = own.select("token", "g").distinct().groupBy("token").agg(F.count("*").alias("f"))
    order = Window.partitionBy("node").orderBy("f", "token")  # the shingles of one text
    ranked = own.join(rarity, "token").withColumn("i", F.row_number().over(order) - 1)
    first = materialize(ranked.where((F.col("f") > 1) & (5 * F.col("i") <= F.col("n"))).select("token", "node", "n", "g", "i"), "prefixes")
    met = materialize(first.join(_mixed(first, "token"), "token"), "met")
    # groups meet before members, so pairs within a group are never formed, and only groups that the bounds allow
    other = met.groupBy("token", F.col("g").alias("h")).agg(F.max(F.col("n") - F.col("i")).alias("deep"), F.min("n").alias("small"), F.max("n").alias("big"))
    fits = (9 * F.least(F.col("n") - F.col("i"), F.col("deep")) >= 4 * (F.col("n") + F.col("small"))) & (5 * F.col("big") >= 4 * F.col("n")) & (5 * F.col("n") >= 4 * F.col("small"))
    left = met.join(other, "token").where((F.col("g") < F.col("h")) & fits).select("token", F.col("node").alias("a"), "n", "i", "h")
    right = met.select("token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("g").alias("h"))
    rest = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    out = left.join(right, ["token", "h"]).where(_near(F.col("n"), F.col("m")) & (9 * rest >= 4 * (F.col("n") + F.col("m")))).select("a", "b").distinct()
    out = materialize(out, "pairs")
    discard(own, first, met)
    return out


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = [np.frombuffer(v.as_buffer(), np.int64) for v in b.column(3)]
        of = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), *(b.column(i).take(of) for i in range(3))], ["token", "node", "n", "g"])


def forest_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes (node, fp) that the vantage-point forest links, as many as there are nodes at most a tree.

    Each fingerprint has one node that speaks for it; the others of the same fingerprint are paired with it.
    """
    speaks = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("c")), "fingerprints")
    same = look_up(nodes, speaks, ["fp"], "c").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    x, y = speaks.select(F.col("fp").alias("a"), F.col("first").alias("x")), speaks.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    near = simhash.links(speaks.select("fp"), RADIUS).join(x, "a").join(y, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return materialize(same.unionByName(near).distinct(), "forest")


def links(rows: DataFrame, sets: DataFrame, turns: int = TURNS, first: DataFrame | None = None) -> DataFrame:
    """(node, component) of the confirmed links that connect the nodes of ``rows`` (bucket, node, n) and of ``first``, pairs (a, b).

    In each turn the buckets that still hold several groups have another centre. What stays apart then is
    compared through shared rare shingles.
    """
    found = None if first is None else materialize(confirmed(first, sets), "links", PAIR_ROWS)
    groups = None if found is None else materialize(components(found), "components")
    for turn in range(turns):
        pairs, members = star_pairs(_grouped(rows, groups), turn)
        new = materialize(confirmed(pairs, sets), "links", PAIR_ROWS)
        found = new if found is None else found.unionByName(new)
        groups = materialize(components(found), "components")
        if turn + 1 < turns:
            discard(members)
    rest = _grouped(members.select("node", "n").distinct(), groups)
    found = found.unionByName(materialize(confirmed(prefix_pairs(rest, sets), sets), "links", PAIR_ROWS))
    discard(members)
    return components(found)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, component): every row of ``docs`` with its group of texts linked at 0.8 or more.

    Texts that are null, empty or without words are one group, and texts of equal sets are. A null id is
    an id like others; repeated rows stay; other columns are not read; an empty table has no groups.
    """
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    rows = materialize(kept.mapInArrow(_nodes, "id long, digest long, node long, n long, fp long, buckets array<long>"), "nodes", 4 * SET_ROWS)
    nodes = rows.groupBy("node").agg(F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    first = forest_pairs(materialize(rows.select("node", "fp").distinct(), "prints"))
    dealt = nodes.select(F.explode("buckets").alias("bucket"), "node", "n")
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    dealt = materialize(dealt.join(shared, "bucket"), "buckets")
    some = dealt.select("node").unionByName(first.select(F.col("a").alias("node"))).unionByName(first.select(F.col("b").alias("node")))
    chosen = rows.join(some.distinct(), "node").groupBy("node").agg(F.min("digest").alias("digest"))
    texts = kept.select("digest", "text").join(chosen.hint("shuffle_hash"), "digest").select("node", "text")
    sets = materialize(texts.mapInArrow(_sets, "node long, shingles binary").dropDuplicates(["node"]), "sets", SET_ROWS)
    linked = links(dealt, sets, first=first)
    return rows.join(linked, "node", "left").select("id", "digest", F.coalesce("component", "node").alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, chosen as :func:`simhash.one_of_each` does."""
    return simhash.one_of_each(docs, id_col, text_col, found=groups(docs, id_col, text_col))
