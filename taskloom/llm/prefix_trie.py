"""Prefix trie of conversations, built from mergeable partial tries.

Each turn of each conversation stands for a node: the sequence of turns up to it, known by a chained SHA-256 digest.
A partition's rows are combined into a partial trie, a table of nodes with what their members add up to; partial
tries are merged by node in rounds, where each round joins groups of partitions. What a subtree sums up is then rolled
up from the ends of the conversations that own nodes (the least member owns a node, and below the first node that a
conversation owns it owns them all), again as partial tries that are merged; so neither depth nor width of the trie
costs rounds. Lists of ends are merged in pieces and read as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import scan
from .common import discard, materialize, parallelism, slices

#: Turns whose digests are chained by one task in one go; longer conversations are chained block by block.
BLOCK = 1024
#: Partial tries that are merged at a time in the first round.
FAN_IN = 64
#: Rows that a worker combines at a time, and ids of ends in one piece of a list.
ROWS = 1 << 16
#: Conversations that share a beginning, and the numbers of turns that they may take from it.
SHARED, TURNS = 100, 6

ROOT = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def content(role: Column, text: Column) -> Column:
    """Digest of a turn: SHA-256 of its role, told apart from its text by the length, and its text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def steps(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, digest, chars): the turns of each conversation, numbered from 1 by turn (null first), then digest.

    Null roles and texts count as empty; rows without a conversation id are left out; repeated rows are turns of their own.
    Numbers come from a scan, so a conversation may span tasks.
    """
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), content(F.col(role_col), F.col(text_col)).alias("digest"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("chars")
    )
    numbered = scan(rows, ["conv"], ["turn", "digest"], count="place")
    out = numbered.select("conv", "place", "digest", "chars")
    out.scratch = numbered.scratch
    return out


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv, kind, place, digest, chars) of rebuilt conversations, in order of kind and place: of kind 0 is a row a
    conversation, of kind 1 the first h turns of the conversation whose turns it shares, of kind 2 its own after its first h.

    own: (conv, place, digest, chars). h is the crc32 of the id's decimal modulo TURNS; shared are the turns of the
    id less its remainder by SHARED, so a turn is handed to 99 others at most.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % TURNS
    convs = own.where("place = 1").select("conv", (F.col("conv") - F.col("conv") % SHARED).alias("base"), h.alias("h"))
    base = own.where((F.col("conv") % SHARED == 0) & (F.col("place") < TURNS)).select(F.col("conv").alias("base"), "place", "digest", "chars")
    heads = convs.where("h > 0").join(base, "base").where("place <= h")
    tops = convs.select("conv", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("chars"))
    return tops.unionByName(heads.select("conv", F.lit(1).alias("kind"), "place", "digest", "chars")).unionByName(own.where(F.col("place") > h).select("conv", F.lit(2).alias("kind"), "place", "digest", "chars"))


def _link(before: bytes, digest: str) -> bytes:
    return hashlib.sha256(before + bytes.fromhex(digest)).digest()[:16]


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests within a block, from rows (conv, block, depth, digest, ...) in that order."""
    at, before = None, b""
    for b in slices(batches):
        own, up = [], []
        for c, k, digest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
            if digest is None:  # the root
                at, before = (c, k), ROOT
                own.append(ROOT)
                up.append(None)
                continue
            start = at != (c, k)
            up.append(None if start else before)
            at, before = (c, k), _link(ROOT if start else before, digest)
            own.append(before)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *b.columns[4:], pa.array(own, pa.binary()), pa.array(up, pa.binary())], ["conv", "block", "depth", "chars", "rest", "is_end", "node", "parent"])


def _joined_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chain over a conversation's blocks, from rows (conv, block, last) in that order: what each next block begins with."""
    at, chain, before = None, b"", b""
    for b in batches:
        out = []
        for c, k, last in zip(*(x.to_pylist() for x in b.columns)):
            node = last if c != at else hashlib.sha256(chain + last).digest()[:16]
            chain = _link(ROOT if c != at else chain, last.hex())
            at, before = c, node
            out.append((c, k + 1, chain, before))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["conv", "block", "chain", "before"])


def _within(chain: Column, node: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(chain, node), 256), 1, 32))


def paths(rows: DataFrame) -> DataFrame:
    """(conv, depth, node, parent, chars, rest, is_end): a row for each conversation and each node on its way, the root
    (depth 0) first. rest: code points from this turn to the conversation's last; is_end: whether it is the last.

    rows: as of :func:`rebuilt`. Depths and rests are scans; digests are chained within blocks of turns and then over blocks.
    """
    forth = scan(rows.withColumn("seq", F.col("kind").cast("long")), ["conv"], ["seq", "place"], count="nth")
    back = scan(forth.select("conv", (F.col("nth") - 1).alias("depth"), "digest", "chars", (-F.col("nth")).alias("turned")), ["conv"], ["turned"], count="left", sums={"rest": "chars"})
    block = F.when(F.col("depth") == 0, 0).otherwise(F.floor((F.col("depth") - 1) / BLOCK)).cast("long")
    dealt = back.select("conv", block.alias("block"), "depth", "digest", "chars", "rest", (F.col("left") == 1).alias("is_end")).repartition(parallelism(rows.sparkSession), "conv", "block").sortWithinPartitions("conv", "block", "depth")
    own = materialize(dealt.mapInArrow(_chained, "conv long, block long, depth long, chars long, rest long, is_end boolean, node binary, parent binary"), "steps")
    discard(forth, back)
    ends = own.where((F.col("depth") > 0) & (F.col("depth") % BLOCK == 0)).select("conv", "block", F.col("node").alias("last"))
    starts = ends.repartition(parallelism(rows.sparkSession), "conv").sortWithinPartitions("conv", "block").mapInArrow(_joined_blocks, "conv long, block long, chain binary, before binary")
    short = own.where("block = 0").drop("block")
    long = own.where("block > 0").join(starts, ["conv", "block"])
    long = long.withColumn("parent", F.when(F.col("parent").isNull(), F.col("before")).otherwise(_within(F.col("chain"), F.col("parent")))).withColumn("node", _within(F.col("chain"), F.col("node")))
    out = materialize(short.unionByName(long.drop("block", "chain", "before")), "paths")
    discard(own)
    return out


def _partial_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partial trie of each stretch of rows (conv, depth, node, parent, chars, rest, is_end): one row a node."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for b in _stretches(batches):
        t = pa.Table.from_batches([b]).append_column("ended", b.column("is_end").cast(pa.int64()))
        t = t.sort_by("conv")
        g = t.group_by(["node"], use_threads=False).aggregate([("depth", "first"), ("parent", "first"), ("chars", "first"), ("conv", "count"), ("ended", "sum"), ("rest", "sum"), ("conv", "first"), ("rest", "first")])
        g = g.select(["node", "depth_first", "parent_first", "chars_first", "conv_count", "ended_sum", "rest_sum", "conv_first", "rest_first"]).combine_chunks()
        names = ["node", "depth", "parent", "chars", "members", "ended", "rest", "owner", "owner_rest", "part"]
        arrays = [g.column(i).chunk(0) if g.num_rows else pa.array([], g.schema.field(i).type) for i in range(9)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(g.num_rows, part, np.int64))], names)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= ROWS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _merged(tries: DataFrame, *sums: Column) -> DataFrame:
    """Partial tries (node, ..., part) merged by node: first groups of ``FAN_IN`` of them, then what that gave."""
    first = tries.groupBy("node", F.floor(F.col("part") / FAN_IN).alias("part")).agg(*sums)
    return first.groupBy("node").agg(*sums)


def _total(c: str) -> Column:
    return F.sum(c).cast("long").alias(c)


def nodes(rows: DataFrame) -> DataFrame:
    """(node, depth, parent, chars, members, ended, rest, owner, owner_rest): the merged trie of :func:`paths`.

    owner: the least member; rest: what is left of all members, their turns at the node counted in.
    """
    tries = rows.mapInArrow(_partial_tries, "node binary, depth long, parent binary, chars long, members long, ended long, rest long, owner long, owner_rest long, part long")
    tries = tries.withColumn("own", F.struct("owner", "owner_rest")).drop("owner", "owner_rest")
    merged = _merged(tries, *(F.first(c).alias(c) for c in ("depth", "parent", "chars")), _total("members"), _total("ended"), _total("rest"), F.min("own").alias("own"))
    return merged.select("node", "depth", "parent", "chars", "members", "ended", "rest", F.col("own.owner").alias("owner"), F.col("own.owner_rest").alias("owner_rest"))


def _rollup(rows: DataFrame, trie: DataFrame) -> DataFrame:
    """(node, texts, leaves): code points of the last texts of all nodes of the subtree, each node once; its childless nodes.

    A conversation that owns nodes owns a way from its first one down to its end. What it adds to an ancestor is that whole
    way, and to a node of its own what is left from there, which is the lesser of what is left at both.
    """
    ways = trie.groupBy(F.col("owner").alias("conv")).agg(F.max("owner_rest").alias("way"), F.max((F.col("members") == F.col("ended")).cast("long")).alias("leaf"))
    # the ways reach the conversations' rows by a scan, which a conversation of any length does not skew
    tops = ways.select("conv", F.lit(-1).cast("long").alias("depth"), F.lit(None).cast("binary").alias("node"), F.lit(None).cast("long").alias("rest"), F.struct("way", "leaf").alias("w"))
    both = tops.unionByName(rows.select("conv", "depth", "node", "rest", F.lit(None).cast("struct<way:bigint,leaf:bigint>").alias("w")))
    met = scan(both, ["conv"], ["depth"], fills={"own": "w"})
    added = met.where("depth >= 0 and own is not null").select("node", F.least("rest", "own.way").alias("texts"), F.col("own.leaf").alias("leaves"), F.spark_partition_id().cast("long").alias("part"))
    out = materialize(_merged(added, _total("texts"), _total("leaves")), "rollup")
    discard(met)
    return out


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (node, first, ids) of the lists of ends, from rows (conv, node) in order of node and conv."""
    for b in _stretches(batches):
        ids, of = b.column(0).to_numpy(), b.column(1)
        start = np.nonzero(np.concatenate([[True], pc.not_equal(of[1:], of[:-1]).to_numpy(zero_copy_only=False)]))[0]
        cut = np.concatenate([start, [len(ids)]])
        text = [",".join(map(str, ids[i:j].tolist())) for i, j in zip(cut, cut[1:])]
        yield pa.RecordBatch.from_arrays([of.take(pa.array(start)), pa.array(ids[start]), pa.array(text)], ["node", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, state = None, None
    for b in slices(batches):
        out = []
        for node, _, ids in zip(*(x.to_pylist() for x in b.columns)):
            if node == at:
                state.update(b",")
            else:
                if at is not None:
                    out.append((at, state.hexdigest()))
                at, state = node, hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.binary(), pa.string()))], ["node", "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """(node, first, ids): the conversations that end at a node, ascending, as decimals joined by commas, in pieces.

    Pieces of a node follow each other in order of ``first``; there is one for each stretch of a task's rows.
    """
    own = rows.where("is_end").select("conv", "node")
    n = parallelism(rows.sparkSession)
    return own.repartitionByRange(n, "node", "conv").sortWithinPartitions("node", "conv").mapInArrow(_ends, "node binary, first long, ids string")


def digests_of_ends(pieces: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of each whole list of ends. A list is read as a stream of its pieces, never held."""
    dealt = pieces.repartition(parallelism(pieces.sparkSession), "node").sortWithinPartitions("node", "first")
    return dealt.mapInArrow(_hashed, "node binary, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """The trie of conversations: one row for each distinct beginning of a conversation.

    rows: (conv, kind, place, digest, chars), of which each conversation has one row of kind 0 with a null digest, and
    its turns in order of kind and place. Returns (node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256); node is the path's digest (32 hex digits, zeros for the root). Equal conversations are
    one way with several ends; an empty table has no nodes.
    """
    way = paths(rows)
    own = materialize(nodes(way), "nodes")
    rolled = _rollup(way, own)
    hashed = digests_of_ends(ends(way))
    wide = ["depth", "parent", "owner", "members", "rest", "texts", "leaves", "children", "ends_sha256"]
    kinds = dict(own.dtypes) | {"texts": "bigint", "leaves": "bigint", "children": "bigint", "ends_sha256": "string"}

    def part(df: DataFrame, *have: str) -> DataFrame:
        return df.select("node", *(F.col(c) if c in have else F.lit(None).cast(kinds[c]).alias(c) for c in wide))

    parts = part(own, "depth", "parent", "owner", "members", "rest").unionByName(part(rolled, "texts", "leaves")).unionByName(part(hashed, "ends_sha256"))
    kids = own.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    parts = parts.unionByName(part(kids, "children"))
    full = parts.groupBy("node").agg(*(F.max(c).alias(c) for c in wide))
    # parents reach their children by a scan, which a parent of very many does not skew
    full = materialize(full, "trie")
    family = full.select(F.col("node").alias("key"), F.lit(0).alias("seq"), "owner", *(F.lit(None).cast(t).alias(c) for c, t in full.dtypes if c not in ("owner", "parent")), F.col("owner").alias("parent_owner"))
    child = full.select(F.col("parent").alias("key"), F.lit(1).alias("seq"), "owner", *(c for c in full.columns if c not in ("owner", "parent")), F.lit(None).cast("long").alias("parent_owner"))
    met = scan(family.unionByName(child), ["key"], ["seq", "node"], fills={"parent_conv_id": "parent_owner"})
    return met.where("seq = 1").select(
        F.lower(F.hex("node")).alias("node"),
        F.col("owner").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("members").alias("n_convs"),
        F.coalesce("children", F.lit(0)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("rest") - F.col("texts")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def op12_prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, as :func:`trie` and :func:`rebuilt` say, by ``conv_id`` and ``depth``."""
    return trie(rebuilt(steps(turns))).drop("node")


#: One step of the crc32 for each bit: b is 256 and a byte where a new byte comes in, else 0.
_BIT = "(CASE WHEN b > 0 THEN xor(a, b - 256) ELSE a END)"
_CRC = f"""xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [256 + ascii(c)::BIGINT] || list_transform(range(7), lambda i: 0::BIGINT))),
        lambda a, b: xor({_BIT} >> 1, 3988292384 * ({_BIT} & 1))))"""

ORACLE = f"""
WITH turns AS (
    SELECT conv_id, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d, length(coalesce(text, '')) AS chars, turn
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (
    SELECT conv_id, list(d ORDER BY turn NULLS FIRST, d) AS ds, list(chars ORDER BY turn NULLS FIRST, d) AS cs FROM turns GROUP BY conv_id),
split AS (SELECT *, conv_id - conv_id % {SHARED} AS base, {_CRC} % {TURNS} AS h FROM own),
whole AS (
    SELECT s.conv_id, coalesce(b.ds[1:s.h], []) || s.ds[s.h + 1:] AS ds, coalesce(b.cs[1:s.h], []) || s.cs[s.h + 1:] AS cs
    FROM split s LEFT JOIN own b ON b.conv_id = s.base),
steps AS (
    SELECT conv_id, d AS depth, ds[1:d] AS path, CASE WHEN d > 0 THEN cs[d] ELSE 0 END AS chars, d = len(ds) AS is_end
    FROM (SELECT *, unnest(range(len(ds) + 1)) AS d FROM whole)),
node AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
    FROM steps GROUP BY path, depth),
child AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
family AS (
    SELECT n.path[1:a] AS path, (n.n_convs - 1) * n.chars AS saved, c.n IS NULL AS leaf
    FROM (SELECT *, unnest(range(depth + 1)) AS a FROM node) n LEFT JOIN child c USING (path)),
below AS (SELECT path, sum(saved) AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves FROM family GROUP BY path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM node n JOIN below b USING (path) LEFT JOIN child c USING (path) LEFT JOIN node p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""
