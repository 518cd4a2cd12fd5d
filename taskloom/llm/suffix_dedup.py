"""Repeated passages by a sparse suffix array over words.

A passage is a run of ``min_words`` words (white space does not matter) that stands at two places
at least, in one text or in several. Suffixes are kept at content-selected positions only: those
whose ``k``-word digest is the least of some ``w`` consecutive ones (minimisers), with
k + w - 1 = min_words // 2 + 5, so equal passages keep an equal position among their first ``w``
words, and that has ``half`` = min_words - (w - 1) words of the passage to its right at least.

1. The kept suffixes are put into one global order by a digest of their next ``half`` words and by the
   128-bit BLAKE2b digest of their next ``min_words`` words, and each is compared with its neighbours.
   (Digests stand in for the words in the order: what matters is that suffixes with a longer common
   beginning are neighbours.) The sort is dealt by (suffix, place), so a passage with a third of all
   places is spread over tasks; the two outer rows of each task are compared afterwards.
2. A neighbour that shares ``min_words`` words is a repeat that starts at a kept position. Repeats
   are then extended to the left and right. A start needs a look-up if its least position shares
   ``half`` words with a neighbour and it could add a word: not if its words are known as later
   occurrences, or are known as first ones and no earlier place shares those ``half`` words. The
   offsets that need it are united over all places that share the ``half`` words, and the passages
   there are sorted by the BLAKE2b digests of their words and compared with their neighbours in the same way.
3. The union of all repeats in a document is given as word spans: words of later occurrences, and
   those that stand in first occurrences only. Occurrences count by document id, then text, then
   place; one that overlaps the first within the same text counts as part of it.

Two passages count as equal if the 128-bit BLAKE2b digests of their words joined by blanks are equal: a
cryptographic digest, for which nobody can make two passages that are not the same words. The digests by which
positions are selected and offsets proposed are shorter and faster, and a collision there costs a look-up and changes
no result. A slice of texts is handled at
once in numpy, and nothing is quadratic in a group's size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialize, parallelism, slices, whole_groups

K = 5
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_LONG = 64  # bytes of a word up to which its digest is a sum over its bytes
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit digests."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_LETTER = mix(np.arange(1000, 1256, dtype=np.uint64))
_POWER = np.multiply.accumulate(np.full(_LONG, _A, np.uint64))


class Words:
    """The words of a slice of texts, numbered through, with digests of runs of words.

    ``first[t]`` is the number of text t's first word, ``first[t + 1]`` that after its last. Digests of
    runs are made by doubling, each step mixed, from digests of the words.
    """

    def __init__(self, texts: pa.Array):
        data = pc.fill_null(texts, "").cast(pa.large_binary())
        offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        flat = np.frombuffer(data.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        solid = ~_SPACE[flat]
        opens, closes = solid.copy(), solid.copy()
        opens[1:] &= ~solid[:-1]
        closes[:-1] &= ~solid[1:]
        some = offsets[:-1] < offsets[1:]
        begin, last = offsets[:-1][some], offsets[1:][some] - 1
        opens[begin], closes[last] = solid[begin], solid[last]
        start = np.nonzero(opens)[0]
        size = np.nonzero(closes)[0] + 1 - start
        self.n = len(start)
        self.first = np.searchsorted(start, offsets)
        letters = flat[solid]
        at = np.cumsum(size) - size
        word = np.repeat(np.arange(self.n), size)
        inner = np.arange(len(letters)) - at[word]
        value = np.zeros(self.n, np.uint64)
        if self.n:
            value = np.add.reduceat(_LETTER[letters] * _POWER[np.minimum(inner, _LONG - 1)], at)
        for i in np.nonzero(size > _LONG)[0].tolist():
            value[i] = xxhash.xxh64_intdigest(letters[at[i] : at[i] + size[i]].tobytes())
        self._levels = [mix(value + size.astype(np.uint64) * _B)]
        spaced = np.full(len(letters) + self.n, 32, np.uint8)
        spaced[np.arange(len(letters)) + word] = letters
        self._bytes = memoryview(spaced.tobytes())
        self._begin = at + np.arange(self.n)
        self._end = self._begin + size

    def _level(self, j: int) -> np.ndarray:
        while len(self._levels) <= j:
            d, s = self._levels[-1], 1 << len(self._levels) - 1
            self._levels.append(mix(d[:-s] * _A + mix(d[s:] ^ _B)) if len(d) > s else d[:0])
        return self._levels[j]

    def runs(self, words: int) -> np.ndarray:
        """64-bit digests of the runs of ``words`` words from each word on, across texts too."""
        n = max(0, self.n - words + 1)
        out, at = None, 0
        for j in reversed(range(words.bit_length())):
            if words >> j & 1:
                d = self._level(j)[at : at + n]
                out = d if out is None else mix(out * _A + mix(d ^ _B))
                at += 1 << j
        return out

    def exact(self, first: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """The 128-bit BLAKE2b digests of the runs of ``words`` words that start at the words ``first``."""
        hashed, own = hashlib.blake2b, self._bytes
        ends = self._end[first + words - 1].tolist() if len(first) else []
        both = np.frombuffer(b"".join(hashed(own[a:b], digest_size=16).digest() for a, b in zip(self._begin[first].tolist(), ends)), np.int64)
        return both[::2], both[1::2]


def least_positions(h: np.ndarray, w: int) -> np.ndarray:
    """For every run of ``w`` digests, in order, the place where its least one stands; of equals the last."""
    view = np.lib.stride_tricks.sliding_window_view(h, w)[:, ::-1]
    return np.arange(len(view)) + (w - 1 - np.argmin(view, axis=1))


def selected(d: Words, k: int, w: int, full: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kept words, their texts, and the first and last of the starts of passages whose least position each is."""
    none = np.zeros(0, np.int64)
    if d.n < full:
        return none, none, none, none
    starts = np.arange(d.n - full + 1)
    of = np.searchsorted(d.first, starts, "right") - 1
    ok = starts + full <= d.first[of + 1]
    starts, of = starts[ok], of[ok]
    if not len(starts):
        return none, none, none, none
    least = least_positions(d.runs(k), w)[starts]
    change = np.nonzero(np.diff(least, prepend=-1))[0]
    return least[change], of[change], starts[change], starts[np.append(change[1:], len(starts)) - 1]


def stretches(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of True start and end."""
    edge = np.diff(covered.astype(np.int8), prepend=0, append=0)
    return np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]


class Line:
    """The words of some documents on one line, with a gap after each, from their rows in document order."""

    def __init__(self, rows: pa.RecordBatch | pa.Table, reach: np.ndarray):
        """``reach``: the word number after the last one that a row speaks of."""
        ids = rows.column("id")
        gone, ids, digest = (x.to_numpy(zero_copy_only=False) for x in (ids.is_null(), ids.fill_null(0), rows.column("digest")))
        new = np.append(True, (gone[1:] != gone[:-1]) | (ids[1:] != ids[:-1]) | (digest[1:] != digest[:-1]))
        self.row = np.nonzero(new)[0]  # a row of each document
        self.of = np.cumsum(new) - 1
        size = np.maximum.reduceat(reach, self.row) + 1
        self.base = np.cumsum(size) - size
        self.length = int(size.sum())

    def covered(self, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The places on the line that the spans of the rows cover."""
        step = np.zeros(self.length + 1, np.int64)
        base = self.base[self.of[rows]]
        np.add.at(step, base + start[rows], 1)
        np.add.at(step, base + end[rows], -1)
        return np.cumsum(step)[:-1] > 0

    def spans(self, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row of the document, start and end of each stretch."""
        s, e = stretches(covered)
        of = np.searchsorted(self.base, s, "right") - 1
        return self.row[of], s - self.base[of], e - self.base[of]


_TEXT = "id long, digest long"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))


def _suffixes(keyed: DataFrame, k: int, w: int, half: int, full: int) -> DataFrame:
    """(near, far, last, id, digest, pos, fore, back): kept suffixes with the digests of their next words.

    near: the next ``half`` words; far, last: the next ``full`` words, 0 if the text ends before or
    the position is not the least of the run that it begins. The passages that have their least
    position here start ``fore`` to ``back`` words before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            d = Words(b.column(2))
            p, of, low, high = selected(d, k, w, full)
            if not len(p):
                continue
            far, last = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            own = high == p  # elsewhere the same passage may not be kept here
            far[own], last[own] = d.exact(p[own], full)
            far[own] |= 1
            columns = [d.runs(half)[p].view(np.int64), far, last, *((x).astype(np.int32) for x in (p - d.first[of], p - high, p - low))]
            near, far, last, pos, fore, back = map(pa.array, columns)
            of = pa.array(of)
            yield pa.RecordBatch.from_arrays([near, far, last, b.column(0).take(of), b.column(1).take(of), pos, fore, back], ["near", "far", "last", "id", "digest", "pos", "fore", "back"])

    return keyed.mapInArrow(run, f"near long, far long, last long, {_TEXT}, pos int, fore int, back int")


def _neighbours(suffixes: DataFrame, partitions: int, full: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (near, far, last, id, digest, pos, ...) with whole, first, front of the rows that share ``near`` with a neighbour.

    whole: a neighbour shares ``far`` and ``last`` too; first: no such row stands before, but for those that
    overlap the first in the same text; front: no row that shares ``near`` stands before (false
    where this can't be told within a batch). Rows for the same place count once. The table behind the
    rows comes second.
    """
    place = ["near", "far", "last", F.col("id").asc_nulls_last(), "digest"]
    dealt = suffixes.repartitionByRange(partitions, *place).sortWithinPartitions(*place, "pos")
    dealt = dealt.withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last row is held back until the next one is known
        held = tail = (False, False)  # of that row: as the row before, wholly as it; as its group's first, edge
        began = None  # the place where its group began
        opening = True  # its group is the task's first
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if last is None else pa.concat_tables([last, t]).combine_chunks()
            near, far, rest, digest, pos = (t.column(c).to_numpy() for c in ("near", "far", "last", "digest", "pos"))
            gone = t.column("id").is_null().to_numpy()
            ids = t.column("id").fill_null(0).to_numpy()
            again = np.zeros(len(near), bool)
            again[1:] = np.all([x[1:] == x[:-1] for x in (near, far, rest, gone, ids, digest, pos)], axis=0)
            if again.any():
                t = t.filter(pa.array(~again)).combine_chunks()
                near, far, rest, digest, pos, gone, ids = (x[~again] for x in (near, far, rest, digest, pos, gone, ids))
            n = t.num_rows
            half, whole = np.zeros(n, bool), np.zeros(n, bool)
            half[1:] = near[1:] == near[:-1]
            whole[1:] = half[1:] & (far[1:] == far[:-1]) & (rest[1:] == rest[:-1]) & (far[1:] != 0)
            if last is None:
                began = (gone[0], ids[0], digest[0], pos[0])
            else:
                half[0], whole[0] = held
            group = np.maximum.accumulate(np.where(whole, -1, np.arange(n)))  # where a row's group begins, -1: before
            places = [np.where(group < 0, old, x[group]) for old, x in zip(began, (gone, ids, digest, pos))]
            own = (gone == places[0]) & (ids == places[1]) & (digest == places[2]) & (pos < places[3] + full)
            first = np.where(group < 0, opening, False) if last is not None else group == 0
            edge = np.where(first & own, 1, 0).astype(np.int32)  # may have a predecessor in the task before
            after_half, after_whole = np.append(half[1:], False), np.append(whole[1:], False)
            family = np.cumsum(~np.append(False, near[1:] == near[:-1]))
            order = np.lexsort((pos, digest, ids, gone, family))
            front = np.zeros(n, bool)
            front[order[np.diff(family[order], prepend=0) > 0]] = True
            front[(family == family[0]) | (family == family[-1])] = False
            yield _judged(t, n - 1, half | after_half, whole | after_whole, own, front, edge)
            opening = bool(first[-1])
            began = tuple(x[-1] for x in places)
            last, held, tail = t.slice(n - 1), (half[-1], whole[-1]), (own[-1], edge[-1])
        if last is not None:
            h, w = (np.array([x]) for x in held)
            yield _judged(last, 1, h, w, np.array([tail[0]]), np.zeros(1, bool), np.array([tail[1] | 2], np.int32))

    def _judged(t, rows, half, whole, own, front, edge) -> pa.RecordBatch:
        keep = np.nonzero((half | (edge > 0))[:rows])[0]
        t = t.take(pa.array(keep)).combine_chunks()
        arrays = [t.column(c).chunk(0) if t.num_rows else pa.array([], t.schema.field(c).type) for c in (*names, "part")]
        return pa.RecordBatch.from_arrays(arrays + [pa.array(x[keep]) for x in (half, whole, own, front, edge)], [*names, "part", "half", "whole", "first", "front", "edge"])

    names = suffixes.columns
    types = ", ".join(f"{n} {t}" for n, t in suffixes.dtypes)
    schema = f"{types}, part int, half boolean, whole boolean, first boolean, front boolean, edge int"
    out = materialize(dealt.mapInArrow(run, schema), "neighbours")
    # a task's last row, and its first group as far as it overlaps the first row's place: a few rows a task
    edges = [r.asDict() for r in out.where("edge > 0").collect()]
    tails = {r["part"]: r for r in edges if r["edge"] & 2}
    heads: dict[int, list[dict]] = {}
    for r in edges:
        if r["edge"] & 1:
            heads.setdefault(r["part"], []).append(r)
    order = sorted(tails)
    for before, part in zip(order, order[1:]):
        a = tails[before]
        for r in heads.get(part, []):
            if r["near"] == a["near"]:
                if r["far"] == a["far"] != 0 and r["last"] == a["last"]:
                    a["half"] = a["whole"] = r["half"] = r["whole"] = True
                    r["first"] = False
                elif r["pos"] == min(x["pos"] for x in heads[part]):
                    a["half"] = r["half"] = True
    mended = out.sparkSession.createDataFrame([tuple(r.values()) for r in edges], schema)
    return out.where("edge = 0").unionByName(mended).where("half").drop("part", "half", "edge"), out


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, k: int = K) -> DataFrame:
    """(id, digest, start, end, first): merged word spans of repeated passages, by document.

    Spans that are not ``first`` hold the words of later occurrences, the others words of first
    occurrences alone. Rows equal in id and text are one document. Null, empty and shorter texts have
    no spans; a null id comes after all others. ``min_words`` is any number from 4 k on, a text's length
    is not limited, and other columns of ``docs`` are not read. An empty table has no spans.
    """
    if min_words < 4 * k:
        raise ValueError("min_words must be at least 4 k")
    w = min_words // 2 + 5 - k + 1
    half = min_words - (w - 1)
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col)
    suffixes = materialize(_suffixes(keyed, k, w, half, min_words), "suffixes")
    if suffixes.isEmpty():
        discard(suffixes)
        return spark.createDataFrame([], f"{_TEXT}, start int, end int, first boolean")
    near, used = _neighbours(suffixes, parallelism(spark), min_words)
    runs = materialize(_runs(near, w, min_words), "runs")
    discard(suffixes, used)
    spans = runs.where("near is null").select("id", "digest", F.col("pos").alias("start"), "end", "first")
    needed = runs.where("need <> 0").groupBy("near", "block").agg(F.bit_or("need").alias("need"))
    needed = materialize(needed, "needed")
    tested = runs.where("near is not null").select("near", "block", "id", "digest", "pos", "reach").join(needed, ["near", "block"])
    tested = tested.select("id", "digest", F.struct("pos", "block", F.col("need").bitwiseAND(F.col("reach")).alias("bits")).alias("t")).where("t.bits <> 0")
    tested = materialize(tested.groupBy("id", "digest").agg(F.collect_set("t").alias("tests")), "tested")
    both = keyed.alias("a").join(tested.alias("b").hint("shuffle_hash"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.digest") == F.col("b.digest")))
    passages = materialize(_passages(both.select("a.id", "a.digest", "text", "tests"), min_words), "passages")
    fine, used = _neighbours(passages, parallelism(spark), min_words)
    fine = fine.where("whole").select("id", "digest", F.col("pos").alias("start"), (F.col("pos") + min_words).alias("end"), "first")
    out = materialize(_joined(spans.unionByName(fine)), "spans")
    discard(runs, needed, tested, passages, used)
    return out


_BITS = 62  # offsets in a block of bits of a long


def _runs(near: DataFrame, w: int, full: int) -> DataFrame:
    """Spans of repeats that start at kept positions, and of each kept position the offsets that need a look-up.

    Spans: (id, digest, pos, end, first). Positions: (id, digest, pos, near, block, need, reach) with bits
    for the offsets (block * 62 + bit) of starts before the position: needed here, and belonging to the position.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["id", "digest"]):
            pos, fore, back = (rows.column(c).to_numpy().astype(np.int64) for c in ("pos", "fore", "back"))
            whole, first, front = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("whole", "first", "front"))
            line = Line(rows, pos + full)
            seen = {kind: line.covered(np.nonzero(whole & (first == kind))[0], pos, pos + full) for kind in (True, False)}
            for kind, covered in seen.items():
                row, start, end = line.spans(covered)
                yield batch(rows, row, pos=start, end=end, first=np.full(len(row), kind))
            # passages all of whose words are known, by the word at which they start
            later, known = (np.concatenate([[0], np.cumsum(~c)]) for c in (seen[False], seen[False] | seen[True]))
            place = line.base[line.of] + pos

            def open_(n: np.ndarray, at: np.ndarray) -> np.ndarray:
                return n[np.minimum(at + full, line.length)] > n[at]

            for block in range((w - 1) // _BITS + 1):
                need, reach = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
                for j in range(block * _BITS, min((block + 1) * _BITS, w)):
                    own = np.nonzero((fore <= j) & (j <= back))[0]
                    at = place[own] - j
                    bit = np.int64(1 << j - block * _BITS)
                    reach[own] |= bit
                    need[own] |= np.where(np.where(front[own], open_(known, at), open_(later, at)), bit, 0)
                some = np.nonzero(reach)[0]
                yield batch(rows, some, pos=pos[some], near=rows.column("near").to_numpy()[some], block=np.full(len(some), block), need=need[some], reach=reach[some])

    schema = [("pos", pa.int32()), ("end", pa.int32()), ("first", pa.bool_()), ("near", pa.int64()), ("block", pa.int32()), ("need", pa.int64()), ("reach", pa.int64())]

    def batch(rows, at: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
        own = rows.select(["id", "digest"]).take(pa.array(at)).combine_chunks()
        added = [pa.array(columns[n].astype(t.to_pandas_dtype()), t) if n in columns else pa.nulls(len(at), t) for n, t in schema]
        return pa.Table.from_arrays([*own.columns, *added], names=["id", "digest", *(n for n, _ in schema)]).combine_chunks().to_batches(max_chunksize=max(1, len(at)))[0] if len(at) else pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2 + [pa.array([], t) for _, t in schema], names=["id", "digest", *(n for n, _ in schema)])

    own = near.repartition(parallelism(near.sparkSession), "id", "digest").sortWithinPartitions("id", "digest")
    return own.mapInArrow(run, f"{_TEXT}, pos int, end int, first boolean, near long, block int, need long, reach long")


def _passages(both: DataFrame, full: int) -> DataFrame:
    """(near, far, last, id, digest, pos): digests of the passages to look up, where they start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            d = Words(b.column(2))
            tests = b.column(3)
            of = np.repeat(np.arange(b.num_rows), pc.list_value_length(tests).to_numpy())
            flat = tests.flatten()
            pos, block, bits = (flat.field(i).to_numpy().astype(np.int64) for i in range(3))
            starts = [np.zeros(0, np.int64)]
            for j in range(_BITS):
                some = np.nonzero(bits >> j & 1)[0]
                starts.append(d.first[of[some]] + pos[some] - block[some] * _BITS - j)
            p = np.unique(np.concatenate(starts))
            near, far = d.exact(p, full)
            of = np.searchsorted(d.first, p, "right") - 1
            rows_of = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(near), pa.array(far | 1), pa.array(far), b.column(0).take(rows_of), b.column(1).take(rows_of), pa.array((p - d.first[of]).astype(np.int32))],
                ["near", "far", "last", "id", "digest", "pos"],
            )

    return both.mapInArrow(run, f"near long, far long, last long, {_TEXT}, pos int")


def _joined(spans: DataFrame) -> DataFrame:
    """Merge a document's spans; words of later occurrences are taken out of first ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["id", "digest"]):
            start, end = (rows.column(c).to_numpy().astype(np.int64) for c in ("start", "end"))
            first = rows.column("first").to_numpy(zero_copy_only=False)
            line = Line(rows, end)
            later = line.covered(np.nonzero(~first)[0], start, end)
            for kind, covered in ((True, line.covered(np.nonzero(first)[0], start, end) & ~later), (False, later)):
                row, s, e = line.spans(covered)
                own = rows.select(["id", "digest"]).take(pa.array(row)).combine_chunks()
                for x in pa.Table.from_arrays([*own.columns, pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(np.full(len(s), kind))], names=["id", "digest", "start", "end", "first"]).to_batches():
                    yield x

    own = spans.repartition(parallelism(spans.sparkSession), "id", "digest").sortWithinPartitions("id", "digest")
    return own.mapInArrow(run, f"{_TEXT}, start int, end int, first boolean")


_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space after each word cut."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, done = [], 0
    for s, e in sorted(spans):
        begin = at[s][0]
        stop = at[e][0] if e < len(at) else len(text)
        out.append(text[done:begin])
        done = stop
    return "".join(out) + text[done:]


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``docs`` with later occurrences of repeated passages cut out of ``text_col``.

    Documents whose words all are later occurrences are dropped; every other row and column stays.
    """
    found = repeats(docs, id_col, text_col, min_words).where("not first")
    own, key, digest, listed = fresh(docs, "own", "key", "digest", "cuts")
    cuts = found.groupBy(F.col("id").alias(key), F.col("digest").alias(digest)).agg(F.collect_list(F.struct("start", "end")).alias(listed))
    cuts = materialize(cuts, "cuts").hint("shuffle_hash")
    both = docs.withColumn(own, F.xxhash64(F.col(text_col)))
    both = both.join(cuts, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(digest)), "left").select(*docs.columns, listed)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            changed = b.column(b.num_columns - 1).is_valid()
            some = b.filter(changed)
            cuts = some.column(b.num_columns - 1).to_pylist()
            texts = [cut_words(t, [(x["start"], x["end"]) for x in c]) for t, c in zip(some.column(at).to_pylist(), cuts)]
            columns = b.columns[:-1]
            columns[at] = pc.replace_with_mask(columns[at], changed, pa.array(texts, columns[at].type))
            kept = np.ones(b.num_rows, bool)
            kept[np.nonzero(changed.to_numpy(zero_copy_only=False))[0]] = [bool(_WORD.search(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1]).filter(pa.array(kept))

    return both.mapInArrow(run, docs.schema)


def op8_suffix_dedup(docs: DataFrame) -> DataFrame:
    out = repeats(docs)
    return out.select(F.col("id").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), "first")
