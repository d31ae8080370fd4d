"""Prefix tree of conversations by truncation peeling.

A conversation is its path: 16 bytes for each turn, twelve of a digest of role and text and four with the text's length
in bytes. Peeling starts at the greatest depth: rows with the same path are one node; then every node loses its last
turn, meets the conversations that end there, and rows with the same shorter path are again one node. Members,
children, leaves and saved tokens are added up on the way, so each level is one grouping of what survived from the level
below, and a node with very many members arrives as one row of each task. A conversation that shares none of its first
16, 32, 64, ... turns with another one is a chain from there on; its nodes are listed without peeling. So the number of
rounds is the greatest depth that conversations share (up to a factor of two), not the longest conversation.

The digest of the conversations that end at a node runs over sorted ids, which are dealt out by range and joined into
short texts of ``CHUNK`` ids each; one task then hashes a node's texts in order, as a stream.

Turns are ordered by number, null first, then by digest. Null roles and texts are empty ones. Repeated rows are turns
of their own. Rows without a conversation belong to none and are left out. Texts may be of any length; other columns
are left out. No conversations give no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from returns_risk.llm.common import table
from returns_risk.sources.store import write_once

#: Bytes of a turn in a path, and conversations in one text of ids.
TURN, CHUNK = 16, 1024
#: First depth at which conversations are tried for sharing no turn further on.
ALONE = 16
NONE_ENDS = hashlib.sha256(b"").hexdigest()

_KEY = "unhex(md5({}))"
_SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def _turns(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = turns.where(F.col(id_col).isNotNull()).selectExpr(
        f"cast({id_col} AS bigint) AS conv_id", f"{turn_col} AS turn", f"coalesce({role_col}, '') AS role",
        f"coalesce({text_col}, '') AS text",
    )
    digest = "substr(md5(concat(string(octet_length(role)), ':', role, text)), 1, 24)"
    return rows.selectExpr("*", f"concat({digest}, lpad(hex(octet_length(text)), 8, '0')) AS step")


def paths(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row for each conversation: conv_id, path."""
    steps = _turns(turns, id_col, turn_col, role_col, text_col).groupBy("conv_id").agg(
        F.expr("sort_array(collect_list(struct(turn, step))) AS steps")
    )
    return steps.selectExpr("conv_id", "unhex(array_join(transform(steps, s -> s.step), '')) AS path")


def _start(paths: DataFrame, path: str, children: str, leaves: str) -> DataFrame:
    return paths.selectExpr(
        f"{path} AS path", "conv_id", "1L AS n_convs", f"{children} AS n_children", f"{leaves} AS n_leaves", "0L AS saved_tokens"
    )


def _chains(ended: DataFrame, deepest: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The conversations without those that go on alone, the rows at which these are met, and their lone nodes."""
    tops, nodes, at = _start(ended.limit(0), "path", "1L", "1L"), [], ALONE
    while at < deepest:
        cut = f"substring(path, 1, {at * TURN})"
        alone = ended.where(f"octet_length(path) >= {at * TURN}").groupBy(F.expr(f"{cut} AS cut")).agg(
            F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.max("path").alias("path")
        ).where(f"n = 1 AND octet_length(path) > {at * TURN}")
        alone = write_once(alone, f"trie-alone-{at}")
        ended = write_once(ended.join(alone.select("conv_id"), "conv_id", "left_anti"), f"trie-met-{at}")
        tops = tops.unionByName(_start(alone, cut, "1L", "1L"))
        lone = alone.selectExpr("*", f"octet_length(path) div {TURN} AS last").selectExpr(
            "*", f"explode(sequence({at + 1}, last)) AS depth"
        )
        nodes.append(lone.selectExpr(
            f"{_KEY.format(f'substring(path, 1, depth * {TURN})')} AS key",
            f"{_KEY.format(f'substring(path, 1, (depth - 1) * {TURN})')} AS parent", "cast(depth AS bigint) AS depth",
            "conv_id", "1L AS n_convs", "if(depth < last, 1L, 0L) AS n_children", "1L AS n_leaves", "0L AS saved_tokens",
        ))
        at *= 2
    return ended, tops, nodes


def _peeled(paths: DataFrame) -> DataFrame:
    """All nodes: key, parent (its key), depth, conv_id and the four sums."""
    length = F.max(F.octet_length("path"))
    deepest = (paths.agg(length).first()[0] or 0) // TURN
    ended, tops, nodes = _chains(paths, deepest)
    if nodes:
        ends = ended.select("path").union(tops.select("path"))
        deepest = (ends.agg(length).first()[0] or 0) // TURN
    rows = _start(ended, "path", "0L", "0L").unionByName(tops)
    below = None
    for depth in range(deepest, -1, -1):
        met = rows.where(f"octet_length(path) = {depth * TURN}")
        if below is not None:
            met = met.unionByName(below.selectExpr(
                f"substring(path, 1, {depth * TURN}) AS path", "conv_id", "n_convs", "1L AS n_children", "n_leaves", "saved_tokens"
            ))
        size = f"cast(conv(hex(substring(path, -4, 4)), 16, 10) AS bigint)" if depth else "0L"
        level = met.groupBy("path").agg(F.min("conv_id").alias("conv_id"), *[F.sum(s).alias(s) for s in _SUMS])
        below = write_once(level.selectExpr(
            "path", "conv_id", "n_convs", "n_children", "if(n_children = 0, 1L, n_leaves) AS n_leaves",
            f"saved_tokens + (n_convs - 1) * {size} AS saved_tokens",
        ), f"trie-{depth}")
        parent = _KEY.format(f"substring(path, 1, {(depth - 1) * TURN})") if depth else "cast(NULL AS binary)"
        nodes.append(below.selectExpr(f"{_KEY.format('path')} AS key", f"{parent} AS parent", f"{depth}L AS depth", "conv_id", *_SUMS))
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionByName(more)
    return out


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, conv_id) in order to rows (key, first, ids): runs of at most ``CHUNK`` ids of one key."""
    key, ids = None, []
    for batch in batches:
        out = []
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (k != key or len(ids) == CHUNK):
                out.append((key, ids[0], ",".join(map(str, ids))))
                ids = []
            key = k
            ids.append(c)
        yield _as_batch(out, _RUNS)
    if ids:
        yield _as_batch([(key, ids[0], ",".join(map(str, ids)))], _RUNS)


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, first, ids) in order to one row (key, ends_sha256) for each key."""
    key, digest = None, None
    for batch in batches:
        out = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if digest is not None and k == key:
                digest.update(b"," + ids.encode())
                continue
            if digest is not None:
                out.append((key, digest.hexdigest()))
            key, digest = k, hashlib.sha256(ids.encode())
        yield _as_batch(out, _ENDS)
    if digest is not None:
        yield _as_batch([(key, digest.hexdigest())], _ENDS)


_RUNS = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
_ENDS = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _ends(paths: DataFrame) -> DataFrame:
    """Digest of the ids of the conversations that end at each node, ascending and joined by commas: key, ends_sha256."""
    ids = paths.selectExpr(f"{_KEY.format('path')} AS key", "conv_id")
    runs = ids.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(
        _joined_ids, "key binary, first bigint, ids string"
    )
    return runs.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed_ids, "key binary, ends_sha256 string")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """The nodes of all ``paths`` (conv_id, path; one row a conversation), the root included.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Runs at once, a job for each level.
    """
    paths = write_once(paths.select("conv_id", "path"), "trie-paths")
    nodes = write_once(_peeled(paths), "trie-nodes")
    parents = nodes.selectExpr("key AS parent", "conv_id AS parent_conv_id")
    out = nodes.join(parents, "parent", "left").join(_ends(paths), "key", "left")
    return out.selectExpr(
        "conv_id", "depth", "parent_conv_id", *_SUMS, f"coalesce(ends_sha256, '{NONE_ENDS}') AS ends_sha256"
    )


def conversation_trie(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """:func:`prefix_trie` of conversations as they are, with the role and text of each node's last turn (root: null)."""
    columns = (id_col, turn_col, role_col, text_col)
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "step")
    last = _turns(turns, *columns).withColumn("depth", F.row_number().over(order).cast("bigint"))
    nodes = prefix_trie(paths(turns, *columns))
    return nodes.join(last.select("conv_id", "depth", "role", "text"), ["conv_id", "depth"], "left")


def rebuilt(paths: DataFrame) -> DataFrame:
    """Conversation c with its first h turns replaced by those of conversation c - c % 5; h = crc32(c) % 9."""
    own = paths.selectExpr(
        "conv_id", "path", "conv_id - conv_id % 5 AS first", f"int(crc32(binary(string(conv_id))) % 9) * {TURN} AS h"
    )
    first = paths.selectExpr("conv_id AS first", "path AS start")
    return own.join(first, "first", "left").selectExpr(
        "conv_id", "concat(substring(coalesce(start, X''), 1, h), substring(path, h + 1)) AS path"
    )


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """All of ``conversations``, rebuilt so that many share their first turns."""
    stored = write_once(paths(table(spark, folder, "conversations")), "trie-own")
    return prefix_trie(rebuilt(stored))
