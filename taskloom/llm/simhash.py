"""SimHash near-duplicates, searched with a forest of vantage-point trees.

One vantage-point tree over 64-bit fingerprints prunes next to nothing: unrelated ones all lie about 32
bits apart, so a ball of radius 3 crosses most boundaries. The forest has a tree for each of several
projections to blocks of bits: of ``blocks`` blocks, a pair within ``max_distance`` bits agrees wholly on
``blocks - max_distance`` of them at least. The Hamming distance of a projection is a pseudo-metric, and
there such a pair is at distance 0, so the triangle bound leaves one branch at a tree's root: the shard of
the projected value. ``blocks`` is the least number for which the shards of evenly spread fingerprints are
small, so it grows with the corpus; results are the same for any number.

Shards that are large all the same are divided by vantage-point nodes: the vantage point is a fingerprint of
the shard, the radius the median of all distances to it under the full metric. What lies within the radius
goes to the inner shard, the rest to the outer one, and by the triangle bound only fingerprints up to
``max_distance`` beyond the radius can be near one within, so these visit the inner shard too. Fingerprints
within ``max_distance`` of the vantage point are linked to it. This goes on until shards are small, or a
vantage point does not divide them (a dense ball); these are compared in blocks of rows that any number of
tasks share. Within a task, shards of over ``NODE_LEAF`` fingerprints are divided by such nodes down to leaves of
that size, which are scanned. No pair is lost; what is emitted are the edges of a spanning forest of each leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, look_up, materialize, slices
from .components import components

SEED = 42
#: Even fingerprints in a shard at most, rows over which a shard is divided between tasks, and rows in a leaf within one.
LEAF, LEAF_LIMIT, NODE_LEAF = 512, 4096, 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of a whole text; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    h = np.fromiter((digest(flat[i:j], SEED) for i, j in zip(start[:n].tolist(), end[k - 1 :].tolist())), np.uint64, n)
    ones = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, digest, fp) for every row; digest: xxhash64 of the text; null and empty texts get fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = [fingerprint(t, shingle) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], ["id", "digest", "fp"])

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, "id long, digest long, fp long")


def masks(blocks: int, max_distance: int, bits: int = 64) -> list[int]:
    """Unions of ``blocks - max_distance`` blocks; a close pair agrees on one of them at least."""
    edge = [bits * i // blocks for i in range(blocks + 1)]
    block = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(block, blocks - max_distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def block_count(n: int, max_distance: int, leaf: int = LEAF, bits: int = 64) -> int:
    """The least number of blocks for which ``n`` even fingerprints give shards of ``leaf`` at most."""
    blocks = max_distance + 1
    while blocks < bits and n > leaf * 2 ** (bits * (blocks - max_distance) / blocks):
        blocks += 1
    return blocks


def shards(nodes: DataFrame, blocks: int, max_distance: int) -> DataFrame:
    """(shard, fp): each fingerprint once for each tree, in the shard of its projection."""
    roots = [F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(mask)))) for t, mask in enumerate(masks(blocks, max_distance))]
    return nodes.select(F.explode(F.array(*roots)).alias("shard"), "fp")


def divided(rows: DataFrame, limit: int, radius: int) -> tuple[DataFrame, DataFrame | None]:
    """Shards of about ``limit`` rows at most, and the links (a, b) to vantage points found on the way.

    A shard of which a child would keep over nine tenths is divided into blocks of rows instead, each of
    which meets each.
    """
    done: list[DataFrame] = []
    stars: list[DataFrame] = []
    for turn in count():
        sizes = rows.groupBy("shard").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("fp", F.lit(turn)).alias("h"), "fp")).alias("v"))
        large = materialize(sizes.where(F.col("n") > limit).select("shard", "n", F.col("v.fp").alias("v")), "large")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, rows.select("shard", "fp")]), reduce(DataFrame.unionByName, stars) if stars else None
        both = materialize(rows.join(large, "shard", "left").withColumn("d", _distance(F.col("fp"), F.col("v"))), "distances")
        done.append(both.where("v is null").select("shard", "fp"))
        both = both.where("v is not null")
        stars.append(both.where((F.col("d") > 0) & (F.col("d") <= radius)).select(F.col("v").alias("a"), F.col("fp").alias("b")))
        # the median of each shard's distances and the sizes of both children, from at most 65 counts a shard
        spread = both.groupBy("shard", "n", "d").agg(F.count("*").alias("c"))
        spread = spread.withColumn("below", F.sum("c").over(Window.partitionBy("shard").orderBy("d")))
        median = spread.groupBy("shard", "n").agg(F.min(F.when(2 * F.col("below") >= F.col("n"), F.col("d"))).alias("r"), F.collect_list(F.struct("d", "c")).alias("at"))
        kept = lambda side: F.aggregate(F.filter("at", side), F.lit(0).cast("long"), lambda x, y: x + y["c"])
        most = F.greatest(kept(lambda x: x["d"] <= F.col("r") + radius), kept(lambda x: x["d"] > F.col("r")))
        median = materialize(median.select("shard", "r", (most > 0.9 * F.col("n")).alias("dense")), "medians")
        both = both.join(median, "shard")
        inner, outer = F.col("d") <= F.col("r") + radius, F.col("d") > F.col("r")
        sides = F.array_compact(F.array(F.when(inner, F.lit(0)), F.when(outer, F.lit(1))))
        child = both.where("not dense").select("shard", "fp", F.explode(sides).alias("side"))
        rows = materialize(child.select(F.xxhash64("shard", "side", F.lit(turn)).alias("shard"), "fp"), "shards")
        blocks = F.ceil(2 * F.col("n") / limit)
        lot = F.pmod(F.xxhash64("fp"), blocks)
        tiles = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda x: F.struct(F.least(x, lot).alias("i"), F.greatest(x, lot).alias("j")))
        dense = both.where("dense").select("shard", "fp", F.explode(tiles).alias("p"))
        done.append(dense.select(F.xxhash64("shard", "p.i", "p.j").alias("shard"), "fp"))


def forest(fp: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (positions) of a spanning forest of the links in rows sorted by shard.

    Row i meets row i + 1, i + 2, ... of its shard, all shards at once.
    """
    n = len(fp)
    label = np.arange(n)
    left, right = [], []
    live = np.arange(n - 1)
    step = 1
    while len(live):
        live = live[live + step < n]
        live = live[shard[live] == shard[live + step]]
        other = live + step
        hit = np.bitwise_count(fp[live] ^ fp[other]) <= radius
        a, b = live[hit], other[hit]
        new = label[a] != label[b]
        if new.any():
            for i, j in zip(a[new].tolist(), b[new].tolist()):
                x, y = label[i], label[j]
                while label[x] != x:
                    x = label[x]
                while label[y] != y:
                    y = label[y]
                if x != y:
                    label[max(x, y)] = min(x, y)
                    left.append(i)
                    right.append(j)
            while not np.array_equal(label[label], label):
                label = label[label]
        step += 1
    return np.array(left, np.int64), np.array(right, np.int64)


def leaves(fp: np.ndarray, radius: int, most: int) -> tuple[list[np.ndarray], list[tuple[int, int, int]]]:
    """Rows (places in ``fp``) of the leaves of a vantage-point tree, and (rows, inner, outer) of each node.

    A node's vantage point is the row of the least digest; the rows up to ``radius`` beyond the median distance from it are
    its inner side, those beyond the median its outer side. Two rows within ``radius`` of each other are both on one
    side, by the triangle inequality, so rows of different sides need not meet. A leaf has ``most`` rows at most,
    unless a side would keep over nine tenths.
    """
    out, nodes = [], []
    waiting = [np.arange(len(fp))]
    lot = fp * np.uint64(0x9E3779B97F4A7C15)
    lot ^= lot >> np.uint64(29)
    while waiting:
        own = waiting.pop()
        if len(own) > most:
            d = np.bitwise_count(fp[own] ^ fp[own[np.argmin(lot[own] * np.uint64(2 * len(nodes) + 1))]])
            r = np.partition(d, len(d) // 2)[len(d) // 2]
            inner, outer = own[d <= r + radius], own[d > r]
            if max(len(inner), len(outer)) <= 0.9 * len(own):
                nodes.append((len(own), len(inner), len(outer)))
                waiting += [inner, outer]
                continue
        out.append(own)
    return out, nodes


def _in_leaves(shard: np.ndarray, fp: np.ndarray, radius: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by shard, with shards of over ``most`` rows as the leaves of their trees: (leaf, fp)."""
    begin = np.nonzero(np.append(True, shard[1:] != shard[:-1]))[0] if len(shard) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(shard)))
    parts, names, n = [], [], 0
    for i in np.nonzero(size > most)[0].tolist():
        for own in leaves(fp[begin[i] : begin[i] + size[i]], radius, most)[0]:
            parts.append(begin[i] + own)
            names.append(np.full(len(own), n))
            n += 1
    small = np.nonzero(np.repeat(size <= most, size))[0]
    at = np.concatenate([small, *parts]) if parts else small
    name = np.concatenate([n + np.repeat(np.arange(len(size)), size)[small], *names])
    return name, fp[at]


def links(nodes: DataFrame, max_distance: int = 3, blocks: int | None = None, limit: int = LEAF_LIMIT) -> DataFrame:
    """(a, b): links within ``max_distance`` bits that connect the distinct fingerprints ``nodes.fp``.

    Every pair within the distance is connected by links, though not each by one of its own.
    """
    rows = shards(nodes, blocks or block_count(nodes.count(), max_distance), max_distance)
    rows, stars = divided(rows, limit, max_distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(shard: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            shard, fp = _in_leaves(shard, fp.view(np.uint64), max_distance, NODE_LEAF)
            i, j = forest(fp, shard, max_distance)
            fp = fp.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            shard, fp = (b.column(k).to_numpy() for k in (0, 1))
            cut = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on in the next batch
            if cut:
                held.append((shard[:cut], fp[:cut]))
                yield found(*map(np.concatenate, zip(*held)))
                held = []
            elif held and held[0][0][-1] != shard[0]:
                yield found(*map(np.concatenate, zip(*held)))
                held = []
            held.append((shard[cut:], fp[cut:]))
        if held:
            yield found(*map(np.concatenate, zip(*held)))

    leaves = rows.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(run, "a long, b long")
    return leaves if stars is None else leaves.unionByName(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_distance: int = 3, **tree) -> DataFrame:
    """(id, digest, fp, component_id, component): every row of ``docs`` with its group.

    component names the group by a fingerprint; component_id is the smallest id reachable over fingerprints at most ``max_distance`` bits apart,
    the row's own included. Texts that are null, empty or without words have fingerprint 0 and link
    like others. A null id keeps its row and never names a group unless the group has only null ids.
    Repeated rows and ids stay as they are; texts may be of any length; an empty table has no groups; other columns of
    ``docs`` are not read. A fingerprint that very many rows have, as that of empty texts, is not shuffled in the end.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "nodes")
    groups = components(links(nodes.select("fp"), max_distance, **tree)).withColumnRenamed("node", "fp")
    linked = nodes.join(groups, "fp")
    first = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialize(groups.join(first, "component").select("fp", "component_id", "component"), "named")
    ids = materialize(nodes.join(named, "fp", "left").select("fp", "n", F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("component", "fp").alias("component")), "ids")
    return look_up(fps, ids, ["fp"], "n").select("id", "digest", "fp", "component_id", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None, **options) -> DataFrame:
    """``docs`` with one row of each group: that of the least id (null last), then text digest.

    Groups are those of :func:`near_duplicates`, or ``found`` (id, digest, component).

    All columns stay as they are. Of rows equal in id and text the first one by its other columns stays.
    An empty table stays empty; columns may have any names.
    """
    found = materialize(near_duplicates(docs, id_col, text_col, **options) if found is None else found, "groups")
    place = F.struct(F.col("id").isNull().alias("no"), "id", "digest")
    best = materialize(found.groupBy("component").agg(F.min(place).alias("best")), "best")
    lost = materialize(found.join(best, "component").where(~place.eqNullSafe(F.col("best"))).select("id", "digest").distinct(), "lost")
    again = materialize(found.groupBy("id", "digest").agg(F.count("*").alias("c")).where("c > 1").select("id", "digest"), "again")
    own_id, own_digest, key_id, key_digest = fresh(docs, "id", "digest", "key_id", "key_digest")

    def named(rows: DataFrame, keys: DataFrame, kind: str) -> DataFrame:
        keys = keys.select(F.col("id").alias(key_id), F.col("digest").alias(key_digest)).hint("shuffle_hash")  # texts need no sort
        return rows.join(keys, F.col(own_id).eqNullSafe(F.col(key_id)) & (F.col(own_digest) == F.col(key_digest)), kind)

    own = docs.withColumns({own_id: F.col(id_col).cast("long"), own_digest: F.xxhash64(F.col(text_col))})
    own = named(own, lost, "left_anti")
    if not again.isEmpty():
        row = F.row_number().over(Window.partitionBy(own_id, own_digest).orderBy(F.to_json(F.struct(*docs.columns))))  # rows of one id and text
        repeated = named(own, again, "left_semi").withColumn(key_id, row).where(F.col(key_id) == 1).drop(key_id)
        own = named(own, again, "left_anti").unionByName(repeated)
    return own.select(*docs.columns)


def op6_simhash(docs: DataFrame) -> DataFrame:
    """The contract's rows of :func:`near_duplicates` over three-word shingles and three bits, a row a document."""
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
