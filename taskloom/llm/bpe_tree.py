"""Byte-level BPE as a monoid: encode halves, join neighbours at their boundary, decode up the tree.

An element is the token list of a text. Two neighbours are joined by re-encoding a window around
their boundary. Both edges of the window have to be *anchors*: a space followed by a printable
ASCII character that is not white space. The split pattern always starts a new match at an anchor,
whatever stands around it (no alternative can take such a space in any place but its first, for
the look-ahead of the white-space run fails there), and merges never cross matches. So tokens left
of the last anchor of the left side and right of the first anchor of the right side are the tokens
of the joined text: they are provably stable. Where no anchor is near, the window grows, up to the
whole side if there is none. The operation is associative and the empty list is neutral.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

LEAF_CHARS = 1024
GROW = 8


class TreeCodec:
    """Encoder and decoder for a rank file (lines of base64 bytes and rank) and a split pattern."""

    def __init__(self, rank_path: str, pattern: str, leaf_chars: int = LEAF_CHARS):
        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.leaf_chars = leaf_chars
        self._leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.token: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.token[i] = b
        self._anchor = [t is not None and len(t) > 1 and t[0] == 0x20 and 0x20 < t[1] < 0x7F for t in self.token]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; lone surrogates are replaced as the leaf encoder does."""
        return self._halves(text, 0, len(text))

    def _halves(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf_chars:
            return self._leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(self._halves(text, lo, mid), self._halves(text, mid, hi))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of the joined texts of two token lists; ``left`` is used up."""
        if not left or not right:
            return left or right
        anchor, n, m = self._anchor, len(left), len(right)
        i, width = n, GROW
        while i > 0:  # the window's left edge: the last anchor, in growing steps
            stop = max(0, n - width)
            i -= 1
            while i > stop and not anchor[left[i]]:
                i -= 1
            if anchor[left[i]]:
                break
            width *= 2
        j, width = 0, GROW
        while j < m and not anchor[right[j]]:
            j += 1
            if j == width:
                width *= 2
        window = self.decode(left[i:] + right[:j]).decode("utf-8", "replace")
        del left[i:]
        left += self._leaf(window)
        left += right[j:]
        return left

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, concatenated up a tree of fixed-size leaves."""
        token, size = self.token, 4096
        parts = [b"".join(map(token.__getitem__, ids[k : k + size])) for k in range(0, len(ids), size)]
        while len(parts) > 1:
            parts = [b"".join(parts[k : k + 2]) for k in range(0, len(parts), 2)]
        return parts[0] if parts else b""


_codecs: dict[tuple, TreeCodec] = {}


def codec(rank_path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> TreeCodec:
    """One codec for each worker process and set of parameters."""
    key = (rank_path, pattern, leaf_chars)
    if key not in _codecs:
        _codecs[key] = TreeCodec(*key)
    return _codecs[key]


def round_trip(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(id, ids array<int>, decoded binary) for every row: the text's ids and their bytes.

    Whole texts are encoded, however long; null and empty texts have no ids and empty bytes.
    Repeated rows stay; an empty table has no rows; other columns are not read. Rows pass in slices of bounded bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_path, pattern, leaf_chars)
        for b in slices(batches):
            ids = [np.array(c.encode(t) if t else [], np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids), pa.array([c.decode(x.tolist()) for x in ids], pa.binary())], ["id", "ids", "decoded"])

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, "id long, ids array<int>, decoded binary")


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))


def with_tokens(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``docs`` with ``token_ids`` of the whole text and ``round_trip``: they decode to its bytes.

    Null and empty texts have no ids and decode to nothing; columns of ``docs`` of these two names, in any
    case, give way to the results; repeated rows stay, an empty table stays empty.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("token_ids", "round_trip")])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_path, pattern, leaf_chars)
        for b in slices(batches):
            ids, same = [], []
            for t in b.column(at).to_pylist():
                x = c.encode(t) if t else []
                same.append(c.decode(x) == (t or "").encode())
                ids.append(np.array(x, np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(ids), pa.array(same, pa.bool_())], [*b.schema.names, "token_ids", "round_trip"])

    added = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def encode_decode_digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Counts and SHA-256 digests of what :func:`round_trip` gives, a row a document."""
    out = round_trip(docs, rank_path, pattern)
    return out.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
