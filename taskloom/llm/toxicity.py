"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

The lexicons are learned: words and word beginnings that are far more frequent, by document, in
toxic than in other training texts. A word's entries are found by the digests of its first 4 to 8
letters and of the whole. The features of a text are lexicon densities, the same near words of the
second person, shares of capitals and of punctuation, and obfuscation rates. Trees are grown by
histograms in numpy on a bounded sample; scores are made probabilities by isotonic regression on a
part of the sample that the trees have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_rows, give_back, slices

#: Labelled rows, and bytes of their texts, that are fetched to fit the model, at most.
SAMPLE_ROWS, SAMPLE_BYTES = 8000, 1 << 26
CELLS = 1 << 19
STEMS = (4, 5, 6, 7, 8)
NEAR = 5

# Pronouns of the second person in English, German, French, Spanish.
SECOND_PERSON = "you your yours yourself du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros".split()
# Signs that stand for letters in disguised words.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_LOWER = bytes((b | 0x20) if 65 <= b <= 90 else b for b in range(256))
_PLAIN = bytes(ord(DISGUISE[chr(b)]) if chr(b) in DISGUISE else (b | 0x20) if 65 <= b <= 90 else b for b in range(256))
_KIND = np.zeros(256, np.int8)  # 0 blank, 1 letter, 2 capital, 3 digit, 4 sign
_KIND[33:128] = 4
_KIND[48:58] = 3
_KIND[65:91] = 2
_KIND[97:123] = 1
_KIND[128:] = 1
_INNER = np.zeros(256, bool)  # signs that count as part of a word when they stand inside
_INNER[[ord(c) for c in "@$*"]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of many texts at once: their texts, places, and digests of beginnings and wholes."""

    def __init__(self, texts: list[bytes]):
        joined = [b" " + t + b" " for t in texts]
        size = np.fromiter(map(len, joined), np.int64, len(joined))
        raw = b"".join(joined)
        self.n = len(texts)
        self.flat = np.frombuffer(raw, np.uint8)
        self.owner = np.repeat(np.arange(self.n), size)
        self.kind = _KIND[self.flat]
        part = (self.kind >= 1) & (self.kind <= 3)
        between = np.zeros(len(part), bool)  # a sign between two parts of a word
        between[1:-1] = _INNER[self.flat[1:-1]] & part[:-2] & part[2:]
        part |= between
        edge = np.diff(part.astype(np.int8), prepend=0, append=0)
        self.start = np.nonzero(edge == 1)[0]
        self.end = np.nonzero(edge == -1)[0]
        self.of = self.owner[self.start] if len(self.start) else np.zeros(0, np.int64)
        self.length = self.end - self.start
        plain = raw.translate(_PLAIN)
        lower = raw.translate(_LOWER)
        self.whole = self._digest(np.frombuffer(lower, np.uint8), self.length)
        plain = np.frombuffer(plain, np.uint8)
        self.stems = [np.where(self.length >= k, self._digest(plain, np.minimum(self.length, k)) + np.uint64(k), 0) for k in STEMS]
        self.keys = [np.where(self.length > 0, self._digest(plain, self.length), 0)] + self.stems

    def _digest(self, flat: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Digest of the first ``length`` bytes of each word: all words at once up to 24 bytes, longer ones singly."""
        h = np.zeros(len(self.start), np.uint64)
        live = np.nonzero(length <= 24)[0]
        for i in range(24):
            live = live[length[live] > i]
            if not len(live):
                break
            h[live] = h[live] * np.uint64(0x100000001B3) + flat[self.start[live] + i] + np.uint64(1)
        for i in np.nonzero(length > 24)[0].tolist():
            h[i] = xxhash.xxh64_intdigest(flat[self.start[i] : self.start[i] + length[i]].tobytes())
        return _mix(h ^ length.astype(np.uint64) << np.uint64(56))

    def per_text(self, value: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.of, value, self.n)


def _cell(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(CELLS)).astype(np.int64)


def _pronouns() -> np.ndarray:
    return np.unique(Words([w.encode() for w in SECOND_PERSON]).whole)


_SECOND = _pronouns()


@dataclass
class Lexicon:
    """Weights by cell, for whole words and for each length of beginnings: cells and their weights."""

    entries: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def tables(self) -> list[np.ndarray]:
        """A table of all cells for each kind, made once in a process."""
        if not hasattr(self, "_tables"):
            self._tables = [np.zeros(CELLS, np.float32) for _ in self.entries]
            for t, (cells, w) in zip(self._tables, self.entries):
                t[cells] = w
        return self._tables

    def __getstate__(self):
        return {"entries": self.entries}

    @classmethod
    def learn(cls, counts: list[np.ndarray], n1: int, n0: int, least: int = 4, ratio: float = 3.0) -> Lexicon:
        """From the numbers of toxic and other documents by key kind, class, and cell."""
        out = []
        for good, bad in counts:
            w = np.log((bad + 0.5) / (n1 + 1)) - np.log((good + 0.5) / (n0 + 1))
            w[(bad < least) | (w < ratio)] = 0
            cells = np.nonzero(w)[0]
            out.append((cells, w[cells].astype(np.float32)))
        return cls(out)

    def hits(self, words: Words) -> np.ndarray:
        """Weight of every word for each of its keys: keys x words."""
        return np.stack([w[_cell(k)] * (k != 0) for w, k in zip(self.tables(), words.keys)])


def _chunks(texts: list[bytes], rows: int = 128) -> Iterator[tuple[slice, Words]]:
    for k in range(0, len(texts), rows):
        yield slice(k, k + rows), Words(texts[k : k + rows])


def document_counts(texts: list[bytes], toxic: np.ndarray) -> np.ndarray:
    """Documents that have a cell, by key kind, class and cell."""
    out = np.zeros((len(STEMS) + 1, 2, CELLS), np.int32)
    for at, words in _chunks(texts):
        y = toxic[at].astype(int)
        for kind, keys in enumerate(words.keys):
            some = keys != 0
            pairs = np.unique(words.of[some] * CELLS + _cell(keys[some]))
            np.add.at(out[kind], (y[pairs // CELLS], pairs % CELLS), 1)
    return out


def features(texts: list[bytes], lexicon: Lexicon) -> np.ndarray:
    """One row of features for each text."""
    w = Words(texts)
    n = w.n
    words = w.per_text()
    den = np.maximum(words, 1)
    hits = lexicon.hits(w)
    best = hits.max(axis=0)
    hit = best > 0
    second = np.isin(w.whole, _SECOND)
    run = np.cumsum(np.append(0, second))
    at = np.arange(len(second))
    near = (run[np.minimum(at + NEAR + 1, len(second))] - run[np.maximum(at - NEAR, 0)] > 0) if len(second) else second
    chars = np.maximum(np.bincount(w.owner, minlength=n) - 2, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(w.owner, mask, n) / chars

    def most(v: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        np.maximum.at(out, w.of, v)
        return out

    capitals = np.append(0, np.cumsum(w.kind == 2))
    digits = np.append(0, np.cumsum(w.kind == 3))
    signs = np.append(0, np.cumsum(_INNER[w.flat]))
    upper = capitals[w.end] - capitals[w.start]
    mixed = (digits[w.end] - digits[w.start] > 0) & (digits[w.end] - digits[w.start] < w.length)
    inner = signs[w.end] - signs[w.start] > 0
    twice = np.zeros(len(w.flat), bool)
    twice[1:] = (w.kind[1:] == 4) & (w.flat[1:] == w.flat[:-1])
    columns = [np.log1p(words)]
    for h in hits:
        columns += [w.per_text(h > 0), w.per_text(h > 0) / den, most(h)]
    columns += [
        w.per_text(hit),
        w.per_text(hit) / den,
        w.per_text(best),
        most(best),
        w.per_text((hits > 0).sum(axis=0) >= 2),
        w.per_text(hit & near) / den,
        w.per_text(second) / den,
        share(w.kind == 2),
        w.per_text((upper == w.length) & (w.length > 1)) / den,
        share(w.kind == 4),
        share(w.flat == ord("!")),
        share(w.flat == ord("?")),
        share(twice),
        w.per_text(mixed) / den,
        w.per_text(inner) / den,
        w.per_text((mixed | inner) & hit),
        w.per_text(w.length == 1) / den,
    ]
    return np.stack(columns, axis=1)


def _bins(x: np.ndarray, most: int = 32) -> list[np.ndarray]:
    cuts = []
    for c in x.T:
        v = np.unique(c)
        cuts.append((v[1:] + v[:-1]) / 2 if len(v) <= most else np.unique(np.quantile(c, np.linspace(0, 1, most + 1)[1:-1])))
    return cuts


@dataclass
class Forest:
    cuts: list[np.ndarray]
    trees: list[tuple] = field(default_factory=list)
    base: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)], axis=1).astype(np.int16)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.full(len(x), self.base)
        for f, t, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            depth = len(leaf).bit_length() - 1
            for _ in range(depth):
                node = 2 * node + 1 + (b[np.arange(len(x)), f[node]] > t[node])
            out += leaf[node - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 5.0) -> Forest:
    """Second-order boosting of complete trees for the logistic loss."""
    p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    forest = Forest(_bins(x), base=float(np.log(p0 / (1 - p0))))
    b = forest.binned(x)
    width = max((len(c) for c in forest.cuts), default=0) + 1
    score = np.full(len(y), forest.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        inner = 2**depth - 1
        f, t = np.zeros(inner, np.int64), np.full(inner, width, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            for c in range(x.shape[1]):
                at = (node - first) * width + b[:, c]
                gs = np.bincount(at, g, count * width).reshape(count, width)
                hs = np.bincount(at, h, count * width).reshape(count, width)
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                cut = gain.argmax(1)
                top = gain[np.arange(count), cut]
                for k in np.nonzero(top > best)[0]:
                    best[k], f[first + k], t[first + k] = top[k], c, cut[k]
            node = 2 * node + 1 + (b[np.arange(len(y)), f[node]] > t[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        values = -rate * gs / (hs + l2)
        forest.trees.append((f, t, values))
        score += values[leaf]
    return forest


def pooled(score: np.ndarray, y: np.ndarray) -> list[list[float]]:
    """Pool adjacent violators: blocks (sum, count, lowest and highest score) of rising means; equal scores are one."""
    at, of, times = np.unique(score, return_inverse=True, return_counts=True)
    blocks: list[list[float]] = []
    for s, v, c in zip(at.tolist(), np.bincount(of, y).tolist(), times.tolist()):
        blocks.append([v, float(c), s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, c2, _, hi = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += c2
            blocks[-1][3] = hi
    return blocks


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability), both rising, of the pooled blocks; means are drawn a little to the middle."""
    blocks = pooled(score, y)
    xs = [x for v, c, lo, hi in blocks for x in (lo, hi)]
    ys = [(v + 0.1) / (c + 0.2) for v, c, _, _ in blocks for _ in (0, 1)]
    return np.array(xs), np.maximum.accumulate(ys)


@dataclass
class ToxicityModel:
    lexicon: Lexicon | None
    forest: Forest | None
    knots: tuple[np.ndarray, np.ndarray] | None
    constant: float = 0.0

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.forest is None:
            return np.full(len(texts), self.constant)
        raw = self.forest.raw(features(texts, self.lexicon))
        return np.clip(np.interp(raw, *self.knots), 0, 1)


def _distinct(texts: list[bytes]) -> np.ndarray:
    """Texts kept of groups of near copies: one for each of three least word-pair digests."""
    top = np.iinfo(np.uint64).max
    least = np.full((3, len(texts)), top)
    for at, w in _chunks(texts):
        same = np.nonzero(w.of[:-1] == w.of[1:])[0]
        pair = _mix(w.whole[same] * np.uint64(31) + w.whole[same + 1])
        for i in range(3):
            np.minimum.at(least[i, at], w.of[same], _mix(pair ^ np.uint64((i + 1) * 0x9E3779B9)))
    keep = np.ones(len(texts), bool)
    for row in least:
        _, first = np.unique(row, return_index=True)
        lone = np.zeros(len(texts), bool)
        lone[first] = True
        keep &= lone | (row == top)
    return keep


def fit(texts: list[str], toxic: list[int], **options) -> ToxicityModel:
    """Fit on labelled texts, near copies once; lexicons and calibration go by folds."""
    return fit_bytes([t.encode("utf-8", "replace") for t in texts], toxic, **options)


def fit_bytes(raw: list[bytes], toxic: list[int], **options) -> ToxicityModel:
    """:func:`fit` on texts in UTF-8."""
    y = np.array(toxic, bool)
    if not len(y) or y.all() or not y.any():
        return ToxicityModel(None, None, None, float(y.mean()) if len(y) else 0.0)
    keep = np.nonzero(_distinct(raw))[0]
    raw, y = [raw[i] for i in keep], y[keep]
    if y.all() or not y.any():
        return ToxicityModel(None, None, None, float(y.mean()))
    # features of a text come from lexicons learned without it
    part = np.arange(len(y)) % 5
    folds = [np.nonzero(part == k)[0] for k in range(5)]
    total = document_counts(raw, y)
    n1, n0 = max(1, int(y.sum())), max(1, int((~y).sum()))
    x = None
    for f in folds:
        own = [raw[i] for i in f]
        bad = int(y[f].sum())
        lexicon = Lexicon.learn(total - document_counts(own, y[f]), max(1, n1 - bad), max(1, n0 - len(f) + bad))
        for k in range(0, len(f), 128):
            rows = features(own[k : k + 128], lexicon)
            x = np.zeros((len(y), rows.shape[1])) if x is None else x
            x[f[k : k + 128]] = rows
    unseen = np.zeros(len(y))
    for k in range(3):
        held = np.arange(len(y)) % 3 == k
        unseen[held] = boost(x[~held], y[~held].astype(float), **options).raw(x[held])
    return ToxicityModel(Lexicon.learn(total, n1, n0), boost(x, y.astype(float), **options), isotonic(unseen, y.astype(float)))


def fit_sample(labelled: DataFrame, text_col: str, label_col: str, order: Column, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on the first ``rows`` rows by ``order`` that have a label, as far as their texts have ``SAMPLE_BYTES``; null texts count as empty."""
    kept = labelled.where(F.col(label_col).isin(0, 1))
    sample = kept.select(F.coalesce(text_col, F.lit("")).alias("t"), F.col(label_col).cast("int").alias("y"), order.alias("o"))
    sample = first_rows(sample, ["o", "t", "y"], "t", rows, SAMPLE_BYTES).select("t", "y").toArrow()
    raw, y = sample.column("t").cast("large_binary").to_pylist(), sample.column("y").to_pylist()
    del sample  # texts are held once
    model = fit_bytes(raw, y)
    del raw
    give_back()
    return model


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``out_col`` (0 to 1) from the whole text alone; null counts as empty.

    A column of ``docs`` of that name, in any case, gives way to the result. Texts may be of any length;
    repeated rows stay, an empty table stays empty.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == out_col.lower()])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows=128):
            raw = [(t or "").encode("utf-8", "replace") for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(raw))], [*b.schema.names, out_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())]))


def labelled(docs: DataFrame, labels: DataFrame, rows: int, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, text, toxic) of up to ``rows`` labelled document ids outside the held-out fold.

    The ids are chosen first, from ids alone; their bounded list then goes to the texts. An id with
    labels of both kinds counts as toxic.
    """
    crc = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds, F.lit(held))
    marks = labels.select("doc_id", "toxic").where((crc != held) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.select("doc_id").where(crc != held).join(marks, "doc_id").distinct()
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit_documents(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    return fit_sample(labelled(docs, labels, rows), "text", "toxic", F.xxhash64("doc_id"), rows)


def op7_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents from labels of those that are not held out; a null id counts as held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    out = score(docs.select("doc_id", "text"), fit_documents(docs, labels))
    return out.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
