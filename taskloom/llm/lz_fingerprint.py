"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed from left to right into phrases: each is the longest one known already and one character more, and
joins the dictionary. The set of phrases is what a compressor would learn from the text, so texts that share much of
it compress each other well. The set is hashed and kept as a minimum-hash signature (the ``KEPT`` least digests),
which estimates the Jaccard similarity of two sets and gives it exactly where both are smaller than that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, parallelism, slices

#: Digests in a signature. The estimate's standard deviation is 0.044 at most.
KEPT = 128
#: Phrases in a dictionary. After so many a new one begins, which bounds the memory of a long text; all phrases count.
DICTIONARY = 1 << 18
#: Characters hashed at once, besides a phrase that crosses the end.
BLOCK = 1 << 16
#: Ranges of ids for each task, so that tasks get about equal parts.
RANGES = 4

_CODES = 0x110000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, x, np.uint64)])) for x in (_ODD, inverse)]
    return _powers


class Parse:
    """A parse that can go on with other text, and go back to where it was marked."""

    def __init__(self):
        self.trie, self.size, self.node, self.at, self.ends = {}, 0, 0, 0, []
        self._mark, self._added = None, None

    def read(self, text: str) -> None:
        trie, size, node, at, ends, added = self.trie, self.size, self.node, self.at, self.ends, self._added
        get, end = trie.get, ends.append
        for c in map(ord, text):
            at += 1
            key = node + c
            node = get(key)
            if node is None:
                size += _CODES
                trie[key] = size
                end(at)
                node = 0
                if added is not None:
                    added.append(key)
                if size == DICTIONARY * _CODES:
                    trie, size = {}, 0
                    get = trie.get
                    if added is not None:
                        self._added = added = None  # the marked dictionary is as it was, but for what was added
        self.trie, self.size, self.node, self.at = trie, size, node, at

    def mark(self) -> None:
        self._added = []
        self._mark = self.trie, self.size, self.node, self.at, len(self.ends), self._added

    def back(self) -> list[int]:
        """The ends since the mark; the parse stands at the mark again."""
        trie, size, node, at, n, added = self._mark
        for key in added:
            del trie[key]
        last = self.ends[n:]
        self.trie, self.size, self.node, self.at, self.ends, self._added = trie, size, node, at, self.ends[:n], None
        return last


def digests(text: str, ends: list[int]) -> np.ndarray:
    """32-bit digests of the phrases of ``text`` that end at ``ends``: polynomials over code points, mixed."""
    out, ends = [], np.array(ends, np.int64)
    i = first = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, first + BLOCK, "right")))
        stop = int(ends[j - 1])
        code = np.frombuffer(text[first:stop].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        up, down = _tables(len(code))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * up[: len(code)])])
        e = ends[i:j] - first
        s = np.concatenate([[0], e[:-1]])
        h = (total[e] - total[s]) * down[s] ^ (e - s).astype(np.uint64) * _M2
        for m in (_M1, _M2):
            h = (h ^ h >> np.uint64(33)) * m
        out.append((h ^ h >> np.uint64(33)) >> np.uint64(32))
        i, first = j, stop
    return np.concatenate(out).astype(np.uint32) if out else np.empty(0, np.uint32)


def _signature(*found: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate(found))[:KEPT]


def signature(text: str | None) -> np.ndarray:
    """The least digests of the text's phrases, ascending; none for a text without characters."""
    parse = Parse()
    parse.read(text := text or "")
    return _signature(digests(text, parse.ends))


def edited(text: str, follower: str) -> str:
    """``text`` with the beginning of ``follower`` in place of its last quarter."""
    n = len(text) // 4
    return text[: len(text) - n] + follower[:n]


def signatures(text: str, follower: str) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of ``text`` and of its edited text; what both have in common is parsed once."""
    cut = len(text) - len(text) // 4
    parse = Parse()
    parse.read(text[:cut])
    parse.mark()
    shared = list(parse.ends)
    parse.read(text[cut:])
    rest = parse.back()
    parse.read(follower[: len(text) - cut])
    own = digests(text, shared + rest)
    other = edited(text, follower)
    last, n = parse.ends[len(shared) :], len(shared)
    start = shared[-1] if shared else 0
    tail = digests(other[start:], [e - start for e in last])
    return _signature(own), _signature(own[:n], tail)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two phrase sets, from 0 to 1; 1 if both are empty."""
    both = np.unique(np.concatenate([a, b]))[:KEPT]
    return float(np.count_nonzero(np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)) / len(both)) if len(both) else 1.0


def as_text(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u4").astype(np.uint32)


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with a fingerprint (eight hex digits for each digest kept) of each whole text; no shuffle.

    Null counts as empty; an empty text has the empty fingerprint. Equal texts have equal ones. A column named
    ``out_col`` gives way; an empty table stays empty. A task holds a slice of texts and one dictionary.
    """
    rest = [c for c in docs.columns if c.lower() != out_col.lower() or c == text_col]
    (text,) = fresh(docs, "lz_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = pa.array([as_text(signature(t)) for t in b.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], own], [*b.schema.names[:-1], out_col])

    kept = [c for c in rest if c.lower() != out_col.lower()]
    schema = docs.select(kept).withColumn(out_col, F.lit("")).schema
    return docs.select(*kept, F.col(text_col).alias(text)).mapInArrow(run, schema)


def similar(pairs: DataFrame, a: str, b: str, out_col: str = "likeness") -> DataFrame:
    """``pairs`` with the likeness of the fingerprints in columns ``a`` and ``b``; null where one of them is null."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*pairs.schema, StructField(out_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            got = [None if x is None or y is None else likeness(from_text(x), from_text(y)) for x, y in zip(rows.column(a).to_pylist(), rows.column(b).to_pylist())]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(got, pa.float64())], [*rows.schema.names, out_col])

    return pairs.mapInArrow(run, schema)


def _range_of(ids: np.ndarray, ties: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each row: between which bounds its id lies; an id that is a bound itself is divided by its ties."""
    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    share = (ties.astype(np.float64) + 2.0**63) / 2.0**64
    return low + np.minimum((share * (high - low + 1)).astype(np.int64), high - low)


_LEAST = -(1 << 63)


def _keys(batch) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow.compute as pc

    return tuple(pc.fill_null(batch.column(i), _LEAST).to_numpy(zero_copy_only=False) for i in (0, 1))


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(range, halo, id, tie, text): rows dealt by ranges of ids and sorted in them, where after the last row of a range
    comes a copy of the row that follows it (``halo``); the very last row is followed by the first.

    Texts are shuffled once. Ids of equal value are ordered by the texts' xxhash64; null ids come first.
    """
    n = parallelism(docs.sparkSession)
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tie"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).cast("double").alias("id"))
    m = RANGES * n
    found = ids.approxQuantile("id", [i / m for i in range(1, m)], 1 / (2 * m)) if m > 1 else []
    bounds = np.array(sorted(min(max(int(x), _LEAST), -_LEAST - 1) for x in found), np.int64)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, t = _keys(b)
            yield pa.RecordBatch.from_arrays([pa.array(_range_of(i, t, bounds)), pa.array(i), pa.array(t)], ["range", "id", "tie"])

    first = keyed.select("id", "tie").mapInArrow(ranged, "range long, id long, tie long").groupBy("range").agg(F.min(F.struct("id", "tie")).alias("f"))
    heads = {r.range: (r.f.id, r.f.tie) for r in first.collect()}  # a row for each of the RANGES * n ranges
    order = sorted(heads)
    before = np.zeros(len(bounds) + 1, np.int64)
    head_id, head_tie = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
    for last, r in zip([order[-1], *order[:-1]] if order else [], order):
        before[r], (head_id[r], head_tie[r]) = last, heads[r]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            i, t = _keys(b)
            r = _range_of(i, t, bounds)
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(np.zeros(len(r), bool)), *b.columns], ["range", "halo", "id", "tie", "text"])
            at = np.nonzero((i == head_id[r]) & (t == head_tie[r]))[0]
            if len(at):
                more = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(before[r[at]]), pa.array(np.ones(len(at), bool)), *more.columns], ["range", "halo", "id", "tie", "text"])

    rows = keyed.mapInArrow(dealt, "range long, halo boolean, id long, tie long, text string")
    return rows.repartitionByRange(n, "range").sortWithinPartitions("range", "halo", "id", "tie")


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): each whole text against its
    edited text and against the next one in ascending order of ids.

    The edited text has the beginning of the next one in place of its last quarter (rounded down); after the last comes
    the first, so a text alone is its own next. Null texts count as empty; null ids come first; rows of equal ids stand
    in the order of their texts' xxhash64, and repeated rows follow each other; each row gets a row. Other columns are
    not read; an empty table gives no rows. A task holds a slice of texts, two neighbours and one dictionary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = done = None  # a row whose next one is not known, and one whose next one has no fingerprint yet
        at = None
        for b in slices(batches):
            out: list[tuple] = []
            for r, halo, i, text in zip(*(b.column(c).to_pylist() for c in ("range", "halo", "id", "text"))):
                if r != at:
                    at, held, done = r, None, None
                if held is not None:
                    other = edited(held[1], text)
                    own, changed = signatures(held[1], text)
                    if done is not None:
                        out.append((*done[:-1], likeness(done[-1], own)))
                    done = held[0], len(held[1]), hashlib.sha256(other.encode()).hexdigest(), as_text(own), as_text(changed), likeness(own, changed), own
                if halo:
                    if done is not None:
                        out.append((*done[:-1], likeness(done[-1], signature(text))))
                    held = done = None
                else:
                    held = i, text
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return in_order(docs, id_col, text_col).mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op11_lz_fingerprint(docs: DataFrame) -> DataFrame:
    """The rows of :func:`with_edits` by ``doc_id``."""
    return with_edits(docs).withColumnRenamed("id", "doc_id")
