"""Embedding near-duplicates over an inverted multi-index.

Vectors are cut in two halves, each with a codebook of its own; pairs of codes form a grid of
cells, within each label. Every vector is stored in its nearest cell. A query visits cells in rising
order of summed half distances (multi-sequence traversal over the two sorted distance lists) until
the distance exceeds the nearest cell's by a slack. The slack is calibrated for the target recall:
it is the quantile, over sampled vectors, of what the traversal needs to come to the cell of a
vector at just the linking cosine in a random direction. Candidates are verified in double
precision. Codebooks and slack come from a bounded sample; all vectors are indexed and are queries.
The number of codes grows with the root of the vectors a label. Each length of vectors that occurs has an
index of its own; one that the sample lacks is fitted on random directions, which costs visits, not links.

Equal vectors of a label (by two 64-bit digests) are one entry with a count, and so are vectors of a single
component with equal signs, whose cosine is 1. Cells with many entries are divided into
blocks of stored times visiting entries, so any number of tasks share a hot cell; a block returns
link counts and the edges of a spanning forest, never its pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, look_up, materialize
from .components import components

#: Rows that are fetched to fit codebooks and slack, at most.
SAMPLE_ROWS = 20_000
CELL_ROWS = 24
BLOCK = 1024


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None], 0)


def codebook(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """k-means centres; fewer if there are fewer distinct rows."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _squares(x, centres).argmin(1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def traversal(da: np.ndarray, db: np.ndarray, slack: float) -> list[int]:
    """Cells (i * len(db) + j) in rising order of da[i] + db[j], up to the least sum plus slack."""
    oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
    sa, sb = da[oa].tolist(), db[ob].tolist()
    heap, out, width = [(sa[0] + sb[0], 0, 0)], [], len(db)
    most = heap[0][0] + slack
    while heap:
        cost, i, j = heapq.heappop(heap)
        if cost > most:
            break
        out.append(int(oa[i]) * width + int(ob[j]))
        if j + 1 < width:
            heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(sa):  # a row opens from its first cell: each cell comes once
            heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))
    return out


@dataclass
class MultiIndex:
    left: np.ndarray
    right: np.ndarray
    slack: float

    @classmethod
    def fit(cls, x: np.ndarray, k: int, cosine: float, recall: float, seed: int = 5) -> MultiIndex:
        """x: unit vectors."""
        cut = x.shape[1] // 2
        index = cls(codebook(x[:, :cut], k), codebook(x[:, cut:], k), 0.0)
        rng = np.random.default_rng(seed)
        q = x[rng.permutation(len(x))[:4000]]
        side = rng.normal(size=q.shape)
        side -= (side * q).sum(1)[:, None] * q
        side /= np.maximum(np.linalg.norm(side, axis=1), 1e-12)[:, None]
        near = cosine * q + np.sqrt(1 - cosine**2) * side
        da, db = index.distances(q)
        home = index.homes(near)
        need = da[np.arange(len(q)), home // len(index.right)] + db[np.arange(len(q)), home % len(index.right)] - da.min(1) - db.min(1)
        index.slack = float(np.quantile(need, recall)) + 1e-12
        return index

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = x.shape[1] // 2
        return _squares(x[:, :cut], self.left), _squares(x[:, cut:], self.right)

    def homes(self, x: np.ndarray) -> np.ndarray:
        da, db = self.distances(x)
        return da.argmin(1) * len(self.right) + db.argmin(1)

    def visits(self, x: np.ndarray) -> list[list[int]]:
        return [traversal(a, b, self.slack) for a, b in zip(*self.distances(x))]

    def reaches(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether the traversal from each of ``x`` comes to each of the cells: vectors x cells."""
        da, db = self.distances(x)
        most = da.min(1) + db.min(1) + self.slack
        return da[:, cells // len(self.right)] + db[:, cells % len(self.right)] <= most[:, None]


def unit(flat: np.ndarray) -> np.ndarray:
    x = flat.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable(vector: Column) -> Column:
    """Not null, of some length, without null or non-finite components, not zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def _indexed(entries: DataFrame, indexes: dict[int, MultiIndex]) -> DataFrame:
    """One stored row for each entry, and a visiting row for each cell it visits."""
    element = dict(entries.dtypes)["vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = pa.array(np.nonzero(dims == dim)[0])
                part = b.take(rows)
                for at in range(0, part.num_rows, 2000):
                    p = part.slice(at, 2000)
                    x = unit(_matrix(p.column(4), dim))
                    home, visits = indexes[dim].homes(x), indexes[dim].visits(x)
                    of = np.repeat(np.arange(p.num_rows), [1 + len(v) for v in visits])
                    cell = np.array([c for h, v in zip(home.tolist(), visits) for c in (h, *v)], np.int32)
                    stored = np.diff(of, prepend=-1) > 0
                    t = p.take(pa.array(of))
                    yield pa.RecordBatch.from_arrays(
                        [t.column(0), t.column(1), pa.array(cell), pa.array(stored), pa.array(home[of].astype(np.int32)), t.column(2), t.column(3), t.column(4)],
                        ["label", "dim", "cell", "stored", "home", "entry", "n", "vector"],
                    )

    return entries.select("label", "dim", "entry", "n", "vector").mapInArrow(run, f"label string, dim int, cell int, stored boolean, home int, entry long, n long, vector {element}")


def spanning(hit: np.ndarray) -> np.ndarray:
    """Component label of every row and column of a bipartite hit matrix, rows first; -1 without hits."""
    n, m = hit.shape
    row, col = np.full(n, n + m), np.arange(n, n + m)
    while True:
        new = np.where(hit.any(1), np.where(hit, col[None], n + m).min(1), n + m)
        back = np.minimum(np.where(hit, new[:, None], n + m).min(0), col)
        if np.array_equal(new, row) and np.array_equal(back, col):
            break
        row, col = new, back
    return np.concatenate([np.where(row < n + m, row, -1), np.where(hit.any(0), col, -1)])


def _block(v: pa.RecordBatch, s: pa.RecordBatch, cosine: float, index: MultiIndex) -> tuple[list, list, list, list]:
    """Link counts (entry, links) and spanning edges (a, b) of visiting rows against stored ones."""
    dim = v.column("dim")[0].as_py()
    q, x = unit(_matrix(v.column("vector"), dim)), unit(_matrix(s.column("vector"), dim))
    a, b = v.column("entry").to_numpy(), s.column("entry").to_numpy()
    nq, nx = v.column("n").to_numpy(), s.column("n").to_numpy()
    hit = (q @ x.T >= cosine) & (a[:, None] != b[None])
    if not hit.any():
        return [], [], [], []
    # the stored side finds the visitor by itself if it visits the visitor's home
    some = np.nonzero(hit.any(0))[0]
    both = np.zeros(hit.shape, bool)
    both[:, some] = index.reaches(x[some], v.column("home").to_numpy()).T
    links_q, links_x = hit @ nx, nq @ (hit & ~both)
    label = spanning(hit)
    node = np.concatenate([a, b])
    linked = np.nonzero(label >= 0)[0]
    return [*a, *b], [*links_q, *links_x], node[linked].tolist(), node[label[linked]].tolist()


def near_duplicates(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.98,
    recall: float = 0.99,
    sample_rows: int = SAMPLE_ROWS,
    cell_rows: int = CELL_ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``rows``.

    Rows link if their labels are equal and not null and their cosine is ``cosine`` at least.
    n_links counts the other rows linked directly, equal rows included; component_id is the least id
    reachable. Vectors that are null, empty, zero, or hold null or non-finite components, and rows
    without label, link with nothing. Vectors of different lengths never link. A row with a null id
    that is reached only by null ids has a null component_id and is kept. Repeated rows stay and link with
    each other; an empty table stays empty; other columns are not read.
    """
    single = dict(rows.dtypes)[vector_col] == "array<float>"  # as narrow as they come; compared in double precision
    vector = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("vector"))
    base = base.withColumn("dim", F.size("vector")).withColumn("vector", F.when(usable(F.col("vector")) & F.col("label").isNotNull(), F.col("vector")))
    base = base.withColumn("vector", F.when(F.col("dim") == 1, F.transform("vector", lambda v: F.signum(v).cast("float" if single else "double"))).otherwise(F.col("vector")))
    keys = {k: F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(i), "label", "vector")) for i, k in enumerate(("k0", "k1"))}
    base = materialize(base.withColumns(keys), "vectors")
    entries = base.where("vector is not null").groupBy("k0", "k1").agg(F.count("*").alias("n"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vector").alias("vector"), F.min("id").alias("least"))
    entries = materialize(entries.withColumn("entry", F.monotonically_increasing_id()), "entries")
    stats = entries.agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).first()
    k = int(max(2, np.ceil((stats.n / max(1, stats.labels) / cell_rows) ** 0.5)))
    sample = entries.select("entry", "dim", "vector").orderBy(F.xxhash64("k0"), "k0", "k1").limit(sample_rows).toArrow()
    found = sample.column("dim").to_numpy()
    indexes = {}
    for dim in (r.dim for r in entries.select("dim").distinct().collect()):  # the lengths of vectors
        own = sample.filter(pa.array(found == dim)).column("vector").combine_chunks()
        x = unit(_matrix(own, dim)) if len(own) >= 2 else unit(np.random.default_rng(dim).normal(size=(4 * k, dim)))
        indexes[dim] = MultiIndex.fit(x, k, cosine, recall)
    dealt = materialize(_indexed(entries, indexes), "cells")
    key = ["label", "dim", "cell"]
    large = dealt.groupBy(*key).agg(F.sum(F.col("stored").cast("long")).alias("s"), F.sum((~F.col("stored")).cast("long")).alias("v")).where((F.col("s") > block) | (F.col("v") > block))
    large = materialize(large.select(*key, F.ceil(F.col("s") / block).alias("ns"), F.ceil(F.col("v") / block).alias("nv")), "large")
    # a visiting row meets every block of stored rows, and a stored row every block of visitors
    one = F.lit(1).cast("long")
    split = dealt.join(large, key, "left").withColumn("ns", F.coalesce("ns", one)).withColumn("nv", F.coalesce("nv", one))
    lot = F.abs(F.xxhash64("entry", "stored") % 1_000_003)
    mine = F.when(F.col("stored"), lot % F.col("ns")).otherwise(lot % F.col("nv"))
    other = F.sequence(F.lit(0).cast("long"), F.when(F.col("stored"), F.col("nv")).otherwise(F.col("ns")) - 1)
    split = split.withColumn("mine", mine).withColumn("other", F.explode(other))
    split = split.withColumn("sb", F.when(F.col("stored"), F.col("mine")).otherwise(F.col("other"))).withColumn("vb", F.when(F.col("stored"), F.col("other")).otherwise(F.col("mine")))
    group = [*key, "sb", "vb"]
    split = split.select(*group, "stored", "home", "entry", "n", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            stored = t.column("stored").to_numpy()
            v, s = t.filter(pa.array(~stored)).combine_chunks(), t.filter(pa.array(stored)).combine_chunks()
            if not v.num_rows or not s.num_rows:
                return []
            e, c, a, b = _block(v.to_batches()[0], s.to_batches()[0], cosine, indexes[v.column("dim")[0].as_py()])
            n = len(e)
            return [pa.RecordBatch.from_arrays([pa.array([*e, *a], pa.int64()), pa.array([*c, *[None] * len(a)], pa.int64()), pa.array([*[None] * n, *b], pa.int64())], ["entry", "links", "other"])] if n else []

        held: list[pa.Table] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            names = [t.column(c).to_pylist() for c in group]
            keys = list(zip(*names))
            start = 0
            for i, name in enumerate(keys):
                if name != last:
                    if i > start:
                        held.append(t.slice(start, i - start))
                    if held:
                        yield from found(pa.concat_tables(held))
                    held, start, last = [], i, name
            held.append(t.slice(start))
        if held:
            yield from found(pa.concat_tables(held))

    ordered = split.repartition(*group).sortWithinPartitions(*group)
    out = materialize(ordered.mapInArrow(run, "entry long, links long, other long"), "links")
    counts = out.where("links is not null").groupBy("entry").agg(F.sum("links").alias("links"))
    groups = components(out.where("other is not null").select(F.col("entry").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "entry")
    named = entries.select("entry", "k0", "k1", "n", "least").join(groups, "entry", "left").withColumn("component", F.coalesce("component", "entry"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").join(counts, "entry", "left")
    named = materialize(named.select("k0", "k1", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id"), "named")
    discard(entries, dealt, large, out)
    alone = base.where("k0 is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = look_up(base.where("k0 is not null").select("id", "k0", "k1"), named, ["k0", "k1"], "n").select("id", "n_links", "component_id")
    return both.unionByName(alone).withColumn("kept", F.col("component_id").eqNullSafe(F.col("id")))


def op9_multi_index(rows: DataFrame) -> DataFrame:
    """The contract's rows of :func:`near_duplicates` at its defaults, a row a vector."""
    return near_duplicates(rows).withColumnRenamed("id", "vec_id")
