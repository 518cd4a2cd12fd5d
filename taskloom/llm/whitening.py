"""Whitening of embeddings: means and covariances by Welford's updates, merged across partitions, and eigenvectors by
symmetric QR.

Vectors are fitted as whole numbers (256 times each entry, rounded down), each distinct one once. A partition goes
through its vectors one by one: each moves the mean and adds a rank-one term to the centred second moments. States of
partitions are merged in rounds by the parallel update formula. Sums of dimensions are kept exactly beside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, parallelism, slices

#: Parts of one before an entry is rounded down.
SCALE = 256
#: Components that are returned, at most.
COMPONENTS = 4
#: States of partitions that are merged by one task, at most.
FAN_IN = 32
#: Iterations of QR for each eigenvalue.
ITERATIONS = 60
_LONG = 1 << 63


def whole(flat: np.ndarray) -> np.ndarray:
    """floor(256 * c) as longs; what a long can't hold becomes the nearest long."""
    x = np.floor(SCALE * flat.astype(np.float64))
    return np.where(x >= 2.0**63, _LONG - 1, np.where(x < -(2.0**63), -_LONG, np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)))


def _usable(b: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of lists (column 1) without nulls and non-finite entries, and these lists as longs."""
    c = b.column(1)
    size = pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = c.flatten()
    bad = ~np.isfinite(pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False))
    end = np.cumsum(size)
    wrong = np.concatenate([[0], np.cumsum(bad)])
    fine = c.is_valid().to_numpy(zero_copy_only=False) & (wrong[end] == wrong[end - size]) & (size > 0)
    x = whole(np.where(bad, 0.0, pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)))
    rows = np.nonzero(fine)[0]
    return rows, [x[end[i] - size[i] : end[i]] for i in rows]


def packed(x: np.ndarray) -> bytes:
    """The vector in the least width of whole number that holds it: equal vectors, and only these, are equal bytes."""
    for t in ("<i1", "<i2", "<i4"):
        if len(x) and np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max:
            return t[2].encode() + x.astype(t).tobytes()
    return b"8" + x.astype("<i8").tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<i{b[:1].decode()}", offset=1).astype(np.int64)


def _distinct_form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        _, xs = _usable(b)
        yield pa.RecordBatch.from_arrays([pa.array([packed(x) for x in xs], pa.binary()), pa.array([len(x) for x in xs], pa.int64())], ["x", "size"])


class State:
    """Count, mean, centred second moments, and exact sums of the vectors seen (high and low halves of each)."""

    def __init__(self, size: int):
        self.n, self.mean, self.moments = 0, np.zeros(size), np.zeros((size, size))
        self.high, self.low = np.zeros(size, np.int64), np.zeros(size, np.int64)

    def add(self, x: np.ndarray) -> None:
        """One vector: a rank-one update."""
        self.n += 1
        off = x - self.mean
        self.mean += off / self.n
        self.moments += np.multiply.outer(off, x - self.mean)
        self.high += x >> 32
        self.low += x & 0xFFFFFFFF

    def merge(self, n: int, mean: np.ndarray, moments: np.ndarray, high: np.ndarray, low: np.ndarray) -> None:
        """The parallel update formula."""
        both = self.n + n
        off = mean - self.mean
        self.moments += moments + np.multiply.outer(off, off) * (self.n * n / both)
        self.mean += off * (n / both)
        self.n = both
        low = self.low + low
        self.high, self.low = self.high + high + (low >> 32), low & 0xFFFFFFFF

    def row(self, size: int) -> tuple:
        return size, self.n, self.mean.tolist(), self.moments.ravel().tolist(), self.high.tolist(), self.low.tolist()


STATE = "size long, n long, mean array<double>, moments array<double>, high array<long>, low array<long>"
_STATE = pa.schema([("size", pa.int64()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("moments", pa.list_(pa.float64())), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))])


def _emitted(states: dict[int, State]) -> Iterator[pa.RecordBatch]:
    for size, s in states.items():
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(s.row(size), _STATE)], schema=_STATE)


def _welford(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state of a partition's vectors (x, size), in order of size: one state is held."""
    states: dict[int, State] = {}
    for b in slices(batches):
        for x, size in zip(b.column(0), b.column(1).to_pylist()):
            if size not in states:
                yield from _emitted(states)
                states = {size: State(size)}
            states[size].add(unpacked(x.as_py()))
    yield from _emitted(states)


def fitted(distinct: DataFrame) -> DataFrame:
    """The state of all vectors of each length, from (x, size): states of partitions, merged ``FAN_IN`` at a time."""
    spark = distinct.sparkSession
    states = materialize(distinct.sortWithinPartitions("size").mapInArrow(_welford, STATE).withColumn("part", F.spark_partition_id().cast("long")), "states", 1)
    parts = (states.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // FAN_IN)
        key = F.floor(F.col("part") / FAN_IN).alias("part")
        dealt = states.select(*_STATE.names, key).repartition(min(parts, parallelism(spark)), "part").sortWithinPartitions("part", "size")
        merged = materialize(dealt.mapInArrow(_parallel, f"{STATE}, part long"), "states", 1)
        discard(states)
        states = merged
        if parts <= 1:
            return states.drop("part")


def _parallel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States merged by (part, size), in whose order they come: one state is held."""
    state, at = None, None
    for b in slices(batches):
        for i in range(b.num_rows):
            row = b.slice(i, 1)
            key = row.column("part")[0].as_py(), row.column("size")[0].as_py()
            if key != at:
                if state is not None:
                    yield _with_part(state, at)
                state, at = State(key[1]), key
            mean, moments, high, low = (row.column(k)[0].values.to_numpy(zero_copy_only=False) for k in ("mean", "moments", "high", "low"))
            state.merge(row.column("n")[0].as_py(), mean, moments.reshape(key[1], key[1]), high, low)
    if state is not None:
        yield _with_part(state, at)


def _with_part(state: State, key: tuple[int, int]) -> pa.RecordBatch:
    own = [pa.array([v], f.type) for v, f in zip(state.row(key[1]), _STATE)]
    return pa.RecordBatch.from_arrays([*own, pa.array([key[0]], pa.int64())], [*_STATE.names, "part"])


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and orthogonal q of q' a q, by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size < 1e-100:  # its square would lose digits; the matrix is scaled to 1
            a[k + 1 :, k] = 0
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = 2 * (p - v * (v @ p))
        a[k + 1 :, k + 1 :] -= np.multiply.outer(v, w) + np.multiply.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        q[:, k + 1 :] -= 2 * np.multiply.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns: implicit QR with Wilkinson's shift.

    Of each vector the entry of largest magnitude (the first of these) is positive.
    """
    scale = np.abs(a).max() or 1.0
    d, e, q = tridiagonal(a / scale)
    q = np.ascontiguousarray(q.T)  # rows are rotated
    high, left = len(d) - 1, ITERATIONS * len(d)
    small = np.finfo(float).eps
    while high > 0:
        done = np.abs(e[:high]) <= small * (np.abs(d[:high]) + np.abs(d[1 : high + 1])) + small**2
        e[:high][done] = 0.0
        if done[high - 1]:
            high -= 1
            continue
        low = int(np.nonzero(done)[0][-1]) + 1 if done.any() else 0
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + np.copysign(np.hypot(half, e[high - 1]), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * dk + 2 * c * s * ek + s * s * dn, s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k + 1 < high:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
        left -= 1
        if left < 0:
            raise ArithmeticError("eigenvalues did not converge")
    order = np.argsort(-d, kind="stable")
    v = q[order]
    lead = np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], 1)
    return d[order] * scale, (v * np.where(lead < 0, -1.0, 1.0)).T


class Model:
    """What whitening needs of one length: count, exact sums, and up to four components with their eigenvalues."""

    def __init__(self, n: int, moments: np.ndarray, high: list[int], low: list[int]):
        self.n, self.sums = n, [(h << 32) + l for h, l in zip(high, low)]
        cov = moments / n
        values, vectors = eigen((cov + cov.T) / 2)
        self.trace = float(np.trace(cov))
        k = min(COMPONENTS, len(values))
        # directions without variance have no scale
        floor = self.trace * len(values) * np.finfo(float).eps
        self.values = [float(v) if v > floor else 0.0 for v in values[:k]]
        self.vectors = vectors[:, :k]

    def deviation(self, xs: np.ndarray) -> list[int | None]:
        """The sums of (n * x - S)^2, exact; null beyond a long."""
        bound = float(self.n) * np.abs(xs.astype(np.float64)).max(initial=0) + float(max(map(abs, self.sums), default=0))
        if bound**2 * max(1, xs.shape[1]) < 2.0**62:
            return ((self.n * xs - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        out = (sum((self.n * int(v) - s) ** 2 for v, s in zip(x, self.sums)) for x in xs)
        return [v if v < _LONG else None for v in out]

    def centred(self, xs: np.ndarray) -> np.ndarray:
        """x - S / n in doubles, without a rounded mean: the whole part of the mean is taken off as whole numbers."""
        base = [s // self.n for s in self.sums]
        rest = np.array([(s - b * self.n) / self.n for s, b in zip(self.sums, base)])
        if max(map(abs, base), default=0) < 1 << 61 and np.abs(xs.astype(np.float64)).max(initial=0) < 2.0**61:
            return (xs - np.array(base, np.int64)).astype(np.float64) - rest
        return (xs.astype(object) - np.array(base, object)).astype(np.float64) - rest

    def whitened(self, xs: np.ndarray) -> np.ndarray:
        """A column a component; NaN for one without variance."""
        own = self.centred(xs) @ self.vectors
        return own / np.array([np.sqrt(v) if v else np.nan for v in self.values])


def _models(states: DataFrame) -> dict[int, Model]:
    """A model for each length of vectors; a state is d * (d + 3) numbers, merged from all partitions."""
    return {r.size: Model(r.n, np.array(r.moments).reshape(r.size, r.size), r.high, r.low) for r in states.toLocalIterator()}


def _checked(models: dict[int, Model]):
    """Sums over a partition's distinct vectors, from which the covariance of their whitened ones follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, list] = {}
        for b in slices(batches):
            xs = [unpacked(x) for x in b.column(0).to_pylist()]
            size = b.column(1).to_numpy()
            for d in np.unique(size).tolist():
                w = np.nan_to_num(models[d].whitened(np.stack([xs[i] for i in np.nonzero(size == d)[0]])))
                s = states.setdefault(d, [0, np.zeros(w.shape[1]), np.zeros((w.shape[1], w.shape[1]))])
                n, mean = len(w), w.mean(axis=0)
                off, both = mean - s[1], s[0] + n
                s[2] += (w - mean).T @ (w - mean) + np.multiply.outer(off, off) * (s[0] * n / both)
                s[1] += off * (n / both)
                s[0] = both
        for d, (n, mean, m) in states.items():
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((d, pa.int64()), (n, pa.int64()), (mean.tolist(), pa.list_(pa.float64())), (m.ravel().tolist(), pa.list_(pa.float64())))], ["size", "n", "mean", "moments"])

    return run


def identity_errors(distinct: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """The largest absolute entry of the covariance of whitened vectors less the identity, for each length.

    Components without variance are left out.
    """
    out: dict[int, list] = {}
    for r in distinct.mapInArrow(_checked(models), "size long, n long, mean array<double>, moments array<double>").toLocalIterator():  # 21 numbers a task
        mean, m = np.array(r.mean), np.array(r.moments).reshape(len(r.mean), -1)
        s = out.setdefault(r.size, [0, np.zeros(len(mean)), np.zeros(m.shape)])
        off, both = mean - s[1], s[0] + r.n
        s[2] += m + np.multiply.outer(off, off) * (s[0] * r.n / both)
        s[1] += off * (r.n / both)
        s[0] = both
    found = {}
    for d, (n, _, m) in out.items():
        kept = [i for i, v in enumerate(models[d].values) if v]
        found[d] = float(np.abs(m[np.ix_(kept, kept)] / n - np.eye(len(kept))).max(initial=0.0))
    return found


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): every vector on up to four principal components
    of the distinct vectors, in units of their standard deviations.

    Rows whose vector is null, empty, or holds null or non-finite entries are left out. Vectors of different lengths are
    fitted apart. Repeated vectors are fitted once and returned for each row; null ids are kept; other columns are not
    read; no usable vector: no rows. Entries that 256 times a double takes beyond a long count as the nearest long; a
    deviation beyond a long is null, and so are ``whitened`` of a component without variance and ``explained`` where
    nothing varies. Equal eigenvalues have any orthogonal components, the same for all rows.
    """
    kept = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    distinct = materialize(kept.mapInArrow(_distinct_form, "x binary, size long").distinct(), "vectors")
    models = _models(fitted(distinct))
    errors = identity_errors(distinct, models)
    discard(distinct)
    spread = {d: [v / m.trace if m.trace > 0 else None for v in m.values] for d, m in models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at, xs = _usable(b)
            size = np.array([len(x) for x in xs], np.int64)
            for d in np.unique(size).tolist():
                m = models[d]
                own = np.nonzero(size == d)[0]
                x = np.stack([xs[i] for i in own])
                k, n = len(m.values), len(own)
                w = m.whitened(x).ravel()
                cols = [
                    b.column(0).take(pa.array(np.repeat(at[own], k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, m.n, np.int64)),
                    pa.array([v for v in m.deviation(x) for _ in range(k)], pa.int64()),
                    pa.array(w, mask=np.isnan(w)),
                    pa.array(spread[d] * n, pa.float64()),
                    pa.array(np.full(n * k, errors[d])),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.mapInArrow(run, f"id {dict(kept.dtypes)['id']}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whitening(rows: DataFrame) -> DataFrame:
    """The rows of :func:`whiten` by ``vec_id``."""
    return whiten(rows).withColumnRenamed("id", "vec_id")
