"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the byte n-grams (1 to 4 bytes, lower-cased, other than letters blanked) of a text.
Each is hashed to a row of an embedding table; a text is the mean of its rows, and a linear layer
with softmax turns the mean into language scores. Table and layer are trained together by
stochastic gradient descent in numpy on a bounded sample. Scores are calibrated by a temperature
fitted on a held-back part of the sample, which also gives the threshold below which a prediction
is rejected. For prediction the layer is folded into the table (the mean commutes with it), so a
text costs one look-up and one addition for each subword.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE, first_rows, slices

#: Labelled rows, and bytes of their texts, that are fetched to fit the model, at most.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 1 << 26
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
NO_LANGUAGE = "und"

# ASCII letters in lower case; other ASCII becomes a blank; bytes of longer characters stay
_FOLD = bytes((b | 0x20) if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def subwords(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of the folded texts, and the text it belongs to, n-gram by n-gram."""
    folded = [b" " + t.translate(_FOLD) + b" " for t in texts]
    size = np.fromiter(map(len, folded), np.int64, len(folded))
    flat = np.frombuffer(b"".join(folded), np.uint8).astype(np.uint32)
    of = np.repeat(np.arange(len(folded), dtype=np.int32), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))  # bytes to the text's end
    h = np.zeros(len(flat), np.uint32)
    hashed, owner = [], []
    blank = flat == 32
    for n in range(1, max(ORDERS) + 1):
        m = len(flat) - n + 1
        h = h[:m] * np.uint32(0x01000193) + flat[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            ok = left[:m] >= n
            if n <= 2:  # no runs of blanks
                ok &= ~blank[:m]
            g = h[:m][ok]
            g ^= g >> np.uint32(15)
            g = g * np.uint32(0x85EBCA6B)
            g ^= g >> np.uint32(13)
            hashed.append(g % np.uint32(buckets))
            owner.append(of[:m][ok])
    return np.concatenate(hashed).astype(np.int64), np.concatenate(owner)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages, the layer folded in
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    buckets: int = field(default=BUCKETS)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        if not texts:
            return out
        hashed, owner = subwords(texts, self.buckets)
        count = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        for c in range(len(self.languages)):
            out[:, c] = np.bincount(owner, self.table[:, c][hashed], len(texts)) / count
        return out + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def _sgd(hashed: list[np.ndarray], y: np.ndarray, classes: int, buckets: int, dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, and the layer's weights and bias."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    layer, bias = np.zeros((dim, classes)), np.zeros(classes)
    total, step = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            lr = rate * (1 - step / total)
            step += 1
            rows, times = hashed[i]
            weight = times / times.sum()
            mean = weight @ emb[rows]
            p = softmax((mean @ layer + bias)[None])[0]
            p[y[i]] -= 1
            back = layer @ p
            layer -= lr * np.outer(mean, p)
            bias -= lr * 0.1 * p
            emb[rows] -= lr * len(rows) ** 0.5 * np.outer(weight, back)
    return emb, layer, bias


def fit(texts: list[str], langs: list[str], buckets: int = BUCKETS, dim: int = 16, epochs: int = 6, rate: float = 2.0, accuracy: float = 0.98, seed: int = 7) -> LanguageModel:
    """Fit on labelled texts; every fifth is held back for temperature and rejection threshold."""
    languages = sorted(set(langs))
    y = np.array([languages.index(x) for x in langs], np.int64)
    if len(languages) < 2:
        return LanguageModel(languages, np.zeros((buckets, len(languages))), np.zeros(len(languages)), buckets=buckets)
    raw = [t.encode("utf-8", "replace") for t in texts]
    hashed = []
    for t in raw:
        rows, times = np.unique(subwords([t], buckets)[0], return_counts=True)
        hashed.append((rows, times.astype(float)))
    held = np.arange(len(y)) % 5 == 4
    use = np.array([len(h[0]) > 0 for h in hashed])
    train = np.nonzero(~held & use)[0]
    emb, layer, bias = _sgd([hashed[i] for i in train], y[train], len(languages), buckets, dim, epochs, rate, seed)
    model = LanguageModel(languages, emb @ layer, bias, buckets=buckets)
    back = np.nonzero(held & use)[0]
    if len(back):
        z = model.logits([raw[i] for i in back])
        grid = np.geomspace(0.01, 10, 61)
        loss = [-np.log(softmax(z / t)[np.arange(len(back)), y[back]] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        order = np.argsort(-p.max(axis=1), kind="stable")
        right = np.cumsum((p.argmax(axis=1) == y[back])[order]) / np.arange(1, len(back) + 1)
        kept = np.nonzero(right >= accuracy)[0]
        model.threshold = float(p.max(axis=1)[order][kept[-1]]) if len(kept) else 1.0
    return model


def fit_sample(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, rows: int = SAMPLE_ROWS, **options) -> LanguageModel:
    """Fit on up to ``rows`` rows that have a text and a language, chosen by digests of their ids.

    The ids are chosen first, each once; their bounded list then goes to the texts. No id gives a
    second row before each of them has given one. Rows end where their texts have ``SAMPLE_BYTES``.
    """
    kept = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    ids = kept.select(F.col(id_col).alias("i")).where("i is not null").distinct().orderBy(F.xxhash64("i"), "i").limit(rows)
    sample = kept.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).join(F.broadcast(ids), "i")
    sample = sample.withColumn("turn", F.row_number().over(Window.partitionBy("i").orderBy("t", "l")))
    sample = sample.withColumn("o", F.xxhash64("i"))
    sample = first_rows(sample, ["turn", "o", "t", "l"], "t", rows, SAMPLE_BYTES).select("t", "l").toArrow()
    return fit(sample.column("t").to_pylist(), sample.column("l").to_pylist(), **options)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for every row, from its whole text alone.

    ``und`` with score 0 and rejected for texts that are null or have no letter, and for all texts
    if no language was learned. rejected: the score is below the calibrated threshold. Texts may be of any
    length (a slice of texts takes some sixty times its bytes); repeated rows stay; other columns are not read.
    Of languages with equal scores the first by name is chosen; an empty table has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.languages + [NO_LANGUAGE])
        for b in slices(batches, most=SLICE // 2):  # subwords take some sixty bytes for each of the text's
            texts = b.column(1).to_pylist()
            ok = np.array([has_letter(t) for t in texts]) & bool(model.languages)
            best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            if ok.any():
                p = model.scores([t.encode("utf-8", "replace") for t, o in zip(texts, ok) if o])
                best[ok], score[ok] = p.argmax(axis=1), p.max(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(~ok | (score < model.threshold))], ["id", "lang_pred", "score", "rejected"])

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, "id long, lang_pred string, score double, rejected boolean")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds, F.lit(0))


def op1_langid(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    learn = docs.where(fold("doc_id", 4) != 2)
    model = fit_sample(learn, "text", "lang", "doc_id", sample_rows)
    out = identify(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
