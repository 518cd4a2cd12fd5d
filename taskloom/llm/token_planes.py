"""Token ids in binary files of shuffled byte planes.

File layout (little-endian): magic ``TKPLANE1``; chunks; index; footer. A chunk holds up to
``block`` ids: the id block as unsigned 32-bit integers is transposed into four byte planes, and
each plane is compressed with zstandard on its own (high planes are nearly constant and all but
vanish). The index is one record a chunk (offset, first id's place in the file, number of ids, four
compressed plane sizes), then a compressed block with the documents' names (signed 64-bit), whether
they are null (8 bits), and lengths (unsigned 64-bit). The footer gives the index's offset, the
number of chunks and documents, the block's size, and the magic again. Any id range can be read from
the footer, the index and the chunks that it meets.

Files are written by tasks under unique names in the shared folder; only those that the committed
manifest lists count, so a repeated or lost task leaves no half file in the data set.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, materialize, parallelism, scratch_path, slices

MAGIC = b"TKPLANE1"
BLOCK = 1 << 16
#: Ids and documents after which a task begins a new file.
FILE_IDS, FILE_DOCS = 1 << 26, 1 << 20
_CHUNK = struct.Struct("<QQI4I")
_FOOT = struct.Struct("<QIQI8s")


def _open(path: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path)


class PlaneWriter:
    """Streams documents' ids into one file; holds one block of ids, and the names and lengths of the file's documents."""

    def __init__(self, sink, block: int = BLOCK, level: int = 3):
        import zstandard

        self._sink, self._block = sink, block
        self._pack = zstandard.ZstdCompressor(level=level).compress
        self._rest = np.zeros(0, np.uint32)
        self._index: list[bytes] = []
        self._names: list[np.ndarray] = []
        self._none: list[np.ndarray] = []
        self._sizes: list[np.ndarray] = []
        self._at = len(MAGIC)
        self._written = 0
        self.ids = self.docs = 0
        sink.write(MAGIC)

    def add(self, names: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Append documents: their names, numbers of ids, and all their ids one after the other."""
        self._none.append(names.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        self._names.append(names.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        self._sizes.append(sizes.astype("<u8"))
        self.ids += len(ids)
        self.docs += len(sizes)
        flat = np.concatenate([self._rest, ids]) if len(self._rest) else ids
        whole = len(flat) // self._block * self._block
        for k in range(0, whole, self._block):
            self._chunk(flat[k : k + self._block])
        self._rest = flat[whole:].copy()

    def _chunk(self, ids: np.ndarray) -> None:
        planes = np.ascontiguousarray(ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)
        packed = [self._pack(p) for p in planes]
        self._index.append(_CHUNK.pack(self._at, self._written, len(ids), *map(len, packed)))
        for p in packed:
            self._sink.write(p)
        self._at += sum(map(len, packed))
        self._written += len(ids)

    def close(self) -> int:
        if len(self._rest):
            self._chunk(self._rest)
        block = self._pack(b"".join(x.tobytes() for part in (self._names, self._none, self._sizes) for x in part))
        self._sink.write(b"".join(self._index) + block)
        self._sink.write(_FOOT.pack(self._at, len(self._index), self.docs, len(block), MAGIC))
        return self.ids


class PlaneReader:
    """Reads a file of planes: document lengths, id ranges, or all documents in order."""

    def __init__(self, source, length: int):
        import zstandard

        self._source = source
        self._unpack = zstandard.ZstdDecompressor().decompress
        source.seek(length - _FOOT.size)
        at, chunks, docs, packed, magic = _FOOT.unpack(source.read(_FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a file of token planes")
        source.seek(at)
        self.index = [_CHUNK.unpack(source.read(_CHUNK.size)) for _ in range(chunks)]
        block = self._unpack(source.read(packed)) if docs else b""
        self.names = pa.array(np.frombuffer(block, "<i8", docs), mask=np.frombuffer(block, np.uint8, docs, 8 * docs).astype(bool))
        self.sizes = np.frombuffer(block, "<u8", docs, 9 * docs).astype(np.int64)

    def chunk(self, k: int) -> np.ndarray:
        at, _, n, *packed = self.index[k]
        self._source.seek(at)
        planes = np.empty((4, n), np.uint8)
        for i, size in enumerate(packed):
            planes[i] = np.frombuffer(self._unpack(self._source.read(size), max_output_size=n), np.uint8)
        return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids of places start..stop-1, from the chunks that hold them alone."""
        firsts = [c[1] for c in self.index]
        k = max(0, int(np.searchsorted(firsts, start, "right")) - 1)
        parts = []
        while k < len(self.index) and firsts[k] < stop:
            parts.append(self.chunk(k)[max(0, start - firsts[k]) : stop - firsts[k]])
            k += 1
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def documents(self) -> Iterator[np.ndarray]:
        k, rest = 0, np.zeros(0, "<u4")
        for size in self.sizes.tolist():
            parts, have = [rest], len(rest)
            while have < size:
                parts.append(self.chunk(k))
                have += len(parts[-1])
                k += 1
            flat = np.concatenate(parts) if len(parts) > 1 else rest
            yield flat[:size]
            rest = flat[size:]


class PieceEncoder:
    """The tokenizers library over whole texts, with a bounded memory of text pieces.

    A text is cut where byte-level pre-tokenization always starts a new word: before a space that a
    character other than white space follows, before a punctuation mark right after a Latin letter or
    digit, and around a line break that stands between such characters. So the ids of the pieces put
    together are the text's ids. Arrow cuts the texts and numbers the distinct pieces; those seen before
    come from memory, and the library encodes the others in a few texts, whose ids are told apart by the
    number of bytes that each stands for. Texts that hold an added token (``<|endoftext|>``) or the mark
    used for cutting go to the library whole. Only tokenizers with plain byte-level pre-tokenization and
    without a normalizer are cut up; with any other, every text is encoded whole.
    """

    _mark = "\x01"  # begins a piece that has no space in front
    _latin = "0-9A-Za-zÀ-ÖØ-öø-ʯ"
    _closing = f"([{_latin}])([.,;:!?])"
    _break = f"([{_latin}.,;:!?])\n([{_latin}])"
    _glued = r" (?:[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|$)"

    def __init__(self, tokenizer_path: str, room: int = 600_000, longest: int = 64):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._cuts = (
            (spec["pre_tokenizer"] or {}).items() >= {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items()
            and not spec["normalizer"]
            and spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
            # an added token with white space around or within could arise from pieces side by side
            and not any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in spec["added_tokens"])
        )
        self._whole = [self._mark, *added]
        vocab = self._tokenizer.get_vocab(with_added_tokens=False)
        self._bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # the byte-level alphabet has one character for each byte
            self._bytes[i] = len(token)
        self._room, self._longest = room, longest
        self._ids: dict[str, bytes] = {}

    def _pieces(self, texts: pa.Array) -> pa.Array:
        """A list of pieces for each text, without the space in front; those that have none begin with the mark."""
        whole = [pc.match_substring(texts, t) for t in self._whole] if self._cuts else [pc.is_valid(texts)]
        whole = reduce(pc.or_, whole).to_numpy(zero_copy_only=False)
        glued = pc.match_substring_regex(texts, self._glued).to_numpy(zero_copy_only=False)
        plain = pa.array(~(whole | glued))
        marked = pc.binary_join_element_wise(self._mark, texts, "")
        cut = pc.replace_substring_regex(marked.filter(plain), self._closing, rf"\1 {self._mark}\2")
        cut = pc.replace_substring_regex(cut, self._break, f"\\1 {self._mark}\n {self._mark}\\2")
        cut = pc.split_pattern(cut, " ")
        if len(cut) == len(texts):
            return cut
        others = np.nonzero(whole | glued)[0]
        lists = [[t] if whole[i] else self._joined(t.split(" ")) for i, t in zip(others.tolist(), marked.take(pa.array(others)).to_pylist())]
        order = np.empty(len(texts), np.int64)
        order[np.append(np.nonzero(plain.to_numpy(zero_copy_only=False))[0], others)] = np.arange(len(texts))
        return pa.concat_arrays([cut, pa.array(lists, cut.type)]).take(pa.array(order))

    @staticmethod
    def _joined(parts: list[str]) -> list[str]:
        """Parts between spaces, put together again where white space or nothing follows the space."""
        out = parts[:1]
        for p in parts[1:]:
            if p and not p[0].isspace():
                out.append(p)
            else:
                out[-1] += " " + p
        return out

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces: those without a space in front each by itself, the others together."""
        bare = [p for p in pieces if p[0] == self._mark]
        for p, ids in zip(bare, self._library([p[1:] for p in bare])):
            self._ids[p] = ids.tobytes()
        spaced = [p for p in pieces if p[0] != self._mark]
        for at in range(0, len(spaced), 512):
            some = spaced[at : at + 512]
            ids = self._library([" " + " ".join(some)])[0]
            end = np.cumsum(self._bytes[ids])
            stops = np.searchsorted(end, np.cumsum([len(p.encode()) + 1 for p in some])) + 1
            flat, begin = ids.tobytes(), 0
            for p, stop in zip(some, (4 * stops).tolist()):
                self._ids[p] = flat[begin:stop]
                begin = stop

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, without special tokens, and the number of ids of each. Null is empty."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        known = self._ids
        if len(known) > self._room:
            known.clear()
        lists = self._pieces(pc.fill_null(texts, ""))
        numbered = lists.flatten().dictionary_encode()
        distinct = numbered.dictionary.to_pylist()
        new = [p for p in distinct if p not in known]
        if new:
            self._learn(new)
        own = [known[p] for p in distinct]
        for p in new:
            if len(p) > self._longest:
                del known[p]
        ids = np.frombuffer(b"".join(own), np.uint32)
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        code = numbered.indices.to_numpy()
        n = size[code]
        end = np.cumsum(n)
        out = ids[np.repeat(np.cumsum(size)[code] - end, n) + np.arange(end[-1])]
        first = lists.offsets.to_numpy()
        return out, np.add.reduceat(n, first[:-1] - first[0])


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def write_planes(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, partitions: int | None = None, file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Write every text's ids, in ascending id order, as files of planes in ``folder``; the manifest.

    Manifest, one row a file: (part, seq, file, n_docs, n_ids, start) with start the number of ids in
    files before. Documents are dealt out by ranges of id and text digest; a task begins a new file
    once one has ``file_ids`` ids or ``file_docs`` documents. Null texts are empty; a null id comes
    first; repeated rows stay. Each document ends with ``end_id``.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        fs, base = _open(folder)
        sink = writer = name = None
        seq = 0

        def closed() -> pa.RecordBatch:
            n_ids = writer.close()
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((seq, pa.int32()), (name, pa.string()), (writer.docs, pa.int64()), (n_ids, pa.int64()))], ["seq", "file", "n_docs", "n_ids"])

        for b in slices(batches, most=8 << 20):
            if writer is None:
                name = f"planes-{uuid.uuid4().hex}"
                sink = fs.open_output_stream(f"{base}/{name}")
                writer = PlaneWriter(sink, block)
            ids, sizes = encode(b.column(1))
            writer.add(b.column(0), sizes + 1, np.insert(ids, np.cumsum(sizes), np.uint32(end_id)))
            if writer.ids >= file_ids or writer.docs >= file_docs:
                yield closed()
                seq, writer = seq + 1, None
        if writer is not None:
            yield closed()

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = partitions or parallelism(spark)
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    # digests, not texts: range bounds are sampled to the driver
    dealt = kept.withColumn("digest", F.xxhash64("text")).repartitionByRange(parts, "id", "digest").sortWithinPartitions("id", "digest").drop("digest")
    files = materialize(dealt.mapInArrow(run, "seq int, file string, n_docs long, n_ids long").withColumn("part", F.spark_partition_id()), "planes-files")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # over one row a file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_planes(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) for every document, read from the files of ``manifest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                path = f"{base}/{name}"
                with fs.open_input_file(path) as f:
                    reader = PlaneReader(f, fs.get_file_info(path).size)
                    crc = np.fromiter((zlib.crc32(ids.data) for ids in reader.documents()), np.int64, len(reader.sizes))
                    starts = start + np.cumsum(reader.sizes) - reader.sizes
                    whole = pa.RecordBatch.from_arrays([reader.names, pa.array(starts), pa.array(reader.sizes), pa.array(crc)], ["id", "start", "n_tokens", "ids_crc32"])
                    for at in range(0, whole.num_rows, 10_000):
                        yield whole.slice(at, 10_000)

    files = manifest.select("file", "start")
    return files.repartition(parallelism(spark), "file").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def token_planes(docs: DataFrame, tokenizer_path: str, end_id: int = 2, **options) -> DataFrame:
    """Write ``docs`` to files of planes in the shared folder and read every document back.

    The files are deleted when all documents are read; use :func:`write_planes` to keep them. Null and empty texts have
    the end id alone; texts may be of any length; repeated rows and ids stay, in the order of :func:`write_planes`; an
    empty table has no files and no rows; other columns are not read.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "planes")
    manifest = write_planes(docs, tokenizer_path, folder, end_id, **options)
    out = materialize(read_planes(spark, folder, manifest), "planes-read")
    delete(spark, folder)
    return out
