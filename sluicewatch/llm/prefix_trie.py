"""Prefix trie of conversations: every distinct beginning, and what sharing it saves.

A turn is a 128-bit hash of its role and text, a conversation the bytes of its turns'
hashes in order, so that bytes sort as sequences of turns do. Equal conversations are
counted first, by partial aggregation. The different ones go to shards by ranges, and a
shard finds its nodes in numpy: turn ids padded into matrices of ``WIDTH`` columns, rows
put in order by ``lexsort``, and changes from row to row OR-accumulated over the columns,
so that the marks of a column are the starts of the nodes of that depth; ``reduceat``
over them aggregates every depth, and children add up into parents from the deepest.

Only nodes on the first and last path of a shard can be in several shards. They come out
with a hash of their prefix, meet by it, and are put right for what was counted in each
shard; there are as many of these as shards times the depth that neighbours share.

A conversation is one value of 16 bytes a turn, which a task must be able to hold; texts
stay in the first scan. Ids of the members that end at a node are hashed as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicewatch.llm.scratch import counted, stored

#: Columns of a padded matrix; longer conversations go on in further matrices.
WIDTH = 64
#: Turns of a shard, about; there are at least as many shards as shuffle partitions.
SHARD_TURNS = 1 << 20
#: The rebuilding of the test conversations: bases are multiples of BASES, and a
#: conversation takes fewer than HEADS turns of its base.
BASES, HEADS = 100, 6

_HASH = 16
_HEAD_BYTES = 512
_KEY_BYTES = 64
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(
    conversations: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(``c``, ``turns``) of every id: its turns in order as (``h``, ``chars``).

    Null turns come first; turns of equal number are put in order by role, then by hash.
    Null roles and texts are empty; rows without an id belong to no conversation.
    """
    said = F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    rows = conversations.where(F.col(id).isNotNull()).select(F.col(id).cast("bigint").alias("c"), F.col(turn).alias("turn"), *said)
    spelled = F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")
    one = F.struct("turn", "role", F.md5(spelled.cast("binary")).alias("h"), F.char_length("text").cast("bigint").alias("chars"))
    grouped = rows.select("c", one.alias("one")).groupBy("c").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    return grouped.select("c", F.transform("turns", lambda t: F.struct(t["h"].alias("h"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """:func:`sequences` whose first h turns are those of their base.

    The base of c is c - c % ``BASES``, h the crc32 of c's decimal digits, modulo
    ``HEADS``: all turns of a base that has fewer, none of one that isn't there.
    """
    first = convs.where(F.col("c") % BASES == 0).select(F.col("c").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % HEADS).cast("int")
    own = convs.withColumn("base", F.col("c") - F.col("c") % BASES).withColumn("n", h)
    both = own.join(counted(first, _HEAD_BYTES), "base", "left")
    none = F.slice("turns", 1, 0)
    return both.select(
        "c",
        F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("n")), F.slice("turns", F.col("n") + 1, F.size("turns"))).alias("turns"),
    )


def trie(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the prefix trie of conversations (``c``, ``turns``), ids being distinct.

    One row for each distinct sequence of first turns, from the root, which has none and
    all conversations, to whole conversations: ``conv_id`` (least member), ``depth``,
    ``parent_conv_id`` (that of the node one turn shorter; null for the root), ``n_convs``
    (members), ``n_children``, ``n_leaves`` (nodes without children in its subtree, itself
    included), ``saved_tokens`` (over its subtree, code points of each node's last text
    for each member but one) and ``ends_sha256`` (of the decimal ids of the members that
    end here, ascending, comma-joined). Conversations of equal turns share all nodes;
    one without turns is a member of the root. No conversations make no nodes.
    """
    spark = convs.sparkSession
    flat = convs.select(
        "c",
        F.unhex(F.array_join(F.transform("turns", lambda t: t["h"]), "")).alias("key"),
        F.transform("turns", lambda t: t["chars"]).alias("chars"),
    )
    flat = stored(flat.withColumn("k", F.unhex(F.md5("key"))), "conversations")
    distinct = flat.groupBy("k").agg(
        F.first("key").alias("key"), F.first("chars").alias("chars"), F.count("*").alias("n"), F.min("c").alias("least")
    )
    different = stored(distinct.join(_ends(flat), "k").drop("k"), "sequences")
    turns = different.agg(F.sum(F.size("chars").cast("bigint"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // shard_turns))
    nodes = stored(different.repartitionByRange(shards, "key").mapInArrow(_shard, _NODE), "nodes")
    shared = stored(_recombined(nodes.where(F.col("key").isNotNull())), "shared")
    names = counted(shared.select(F.col("key").alias("parent_key"), F.col("least").alias("of_parent")), _KEY_BYTES)
    inner = nodes.where(F.col("key").isNull())
    columns = [c for c in nodes.columns if c in shared.columns]
    below = inner.where(F.col("parent_key").isNotNull()).select(*columns).unionByName(shared.select(*columns))
    parts = (
        inner.where(F.col("parent_key").isNull()).select(*_result(F.col("parent"))),
        below.join(names, "parent_key", "left").select(*_result(F.col("of_parent"))),
    )
    return parts[0].unionByName(parts[1])


def _result(parent: Column) -> list[Column]:
    return [
        F.col("least").alias("conv_id"),
        "depth",
        parent.alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    ]


def _ends(flat: DataFrame) -> DataFrame:
    """(``k``, ``ends``): the hash of the ids of each distinct conversation, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state = None, None
        for batch in batches:
            done = []
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != of:
                    if state:
                        done.append((of, state.hexdigest()))
                    of, state = k, hashlib.sha256(b"%d" % c)
                else:
                    state.update(b",%d" % c)
            yield rows(done)
        if state:
            yield rows([(of, state.hexdigest())])

    def rows(done: list) -> pa.RecordBatch:
        columns = [pa.array([x[i] for x in done], kind) for i, kind in enumerate((pa.binary(), pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["k", "ends"])

    ordered = flat.select("k", "c").repartition("k").sortWithinPartitions("k", "c")
    return ordered.mapInArrow(run, "k binary, ends string")


#: ``key`` is the prefix's hash of nodes that other shards may have too, ``parent_key``
#: their hash for nodes with such a parent; ``parent`` the least member of other parents.
_NODE = (
    "key binary, parent_key binary, parent bigint, depth bigint, least bigint, n bigint, "
    "children bigint, leaves bigint, saved bigint, chars bigint, ends string"
)


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, chars, n, least, ends = [], [], [], [], []
    for batch in batches:
        keys += batch.column(0).to_pylist()
        chars.append(batch.column(1).flatten().to_numpy())
        n.append(batch.column(2).to_numpy())
        least.append(batch.column(3).to_numpy())
        ends += batch.column(4).to_pylist()
    if not keys:
        return
    shard = Shard(keys, np.concatenate(chars), np.concatenate(n), np.concatenate(least))
    hashes = shard.outer_paths()
    key, parent_key, end = ([None] * shard.n.size for _ in range(3))
    for node, value in hashes.items():
        key[node] = value
    parent = shard.parent.tolist()
    outer = np.zeros(shard.n.size, dtype=bool)
    outer[list(hashes)] = True
    for node in np.flatnonzero(outer[np.maximum(shard.parent, 0)] & (shard.parent >= 0)):
        parent_key[node] = hashes[parent[node]]
    for row, node in enumerate(shard.node_of):
        end[node] = ends[row]
    known = np.array([k is None for k in parent_key]) & (shard.parent >= 0)
    columns = [
        pa.array(key, pa.binary()), pa.array(parent_key, pa.binary()),
        pa.array(shard.least[np.maximum(shard.parent, 0)], mask=~known),
        *map(pa.array, (shard.depth, shard.least, shard.n, shard.children, shard.leaves, shard.saved, shard.chars)),
        pa.array(end, pa.string()),
    ]
    names = [f.split()[0] for f in _NODE.split(", ")]
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    for start in range(0, whole.num_rows, 1 << 14):
        yield whole.slice(start, 1 << 14)


class Shard:
    """Nodes of distinct conversations: ``parent`` (-1: root), ``depth``, ``n``, ``least``,
    ``chars``, ``children``, ``leaves``, ``saved``, and ``node_of`` each row its last node.

    ``chars`` has the lengths of all rows' turns one after the other.
    """

    def __init__(self, keys: list[bytes], chars: np.ndarray, n: np.ndarray, least: np.ndarray):
        self.keys = keys
        self.sizes = np.array([len(k) // _HASH for k in keys], dtype=np.int64)
        self.node_of = np.zeros(len(keys), dtype=np.int64)
        start = np.cumsum(self.sizes) - self.sizes
        ids = _dense(b"".join(keys))
        levels = [(np.array([-1]), np.array([n.sum()]), np.array([least.min()]), np.array([0]))]
        self.first = [0]  # node of each depth
        for done in range(0, int(self.sizes.max()), WIDTH):
            rows = np.flatnonzero(self.sizes > done)
            width = min(WIDTH, int(self.sizes[rows].max()) - done)
            column = np.arange(width)
            within = column < (self.sizes[rows] - done)[:, None]
            turns = np.zeros((rows.size, width), dtype=np.int64)
            turns[within] = ids[((start[rows] + done)[:, None] + column)[within]]
            order = np.lexsort((*turns.T[::-1], self.node_of[rows]))
            rows, turns = rows[order], turns[order]
            change = np.ones(turns.shape, dtype=bool)
            change[1:] = turns[1:] != turns[:-1]
            above = self.node_of[rows]
            change[1:, 0] |= above[1:] != above[:-1]
            change = np.logical_or.accumulate(change, axis=1)
            for j in range(width):
                starts = np.flatnonzero(change[:, j])
                live = turns[starts, j] != 0
                heads = rows[starts[live]]
                first = self.first[-1] + levels[-1][0].size
                number = np.full(starts.size, -1)
                number[live] = first + np.arange(heads.size)
                levels.append((
                    self.node_of[heads],
                    np.add.reduceat(n[rows], starts)[live],
                    np.minimum.reduceat(least[rows], starts)[live],
                    chars[start[heads] + done + j],
                ))
                self.first.append(first)
                node = number[np.cumsum(change[:, j]) - 1]
                self.node_of[rows[node >= 0]] = node[node >= 0]
        self.parent, self.n, self.least, self.chars = (np.concatenate(x).astype(np.int64) for x in zip(*levels))
        self.depth = np.repeat(np.arange(len(levels)), [x[0].size for x in levels])
        self.children = np.bincount(self.parent[1:], minlength=self.n.size)
        self.leaves = (self.children == 0).astype(np.int64)
        self.saved = (self.n - 1) * self.chars
        for d in range(len(levels) - 1, 0, -1):
            own = slice(self.first[d], self.first[d] + levels[d][0].size)
            np.add.at(self.leaves, self.parent[own], self.leaves[own])
            np.add.at(self.saved, self.parent[own], self.saved[own])

    def outer_paths(self) -> dict[int, bytes]:
        """Nodes on the paths of the first and the last row, with their prefix's hash."""
        found: dict[int, bytes] = {}
        for key in (min(self.keys), max(self.keys)):
            node, path = int(self.node_of[self.keys.index(key)]), []
            while node >= 0:
                path.append(node)
                node = int(self.parent[node])
            state = hashlib.blake2b(digest_size=_HASH)
            for depth, node in enumerate(reversed(path)):
                if depth:
                    state.update(key[(depth - 1) * _HASH : depth * _HASH])
                found[node] = state.copy().digest()
        return found


def _dense(hashes: bytes) -> np.ndarray:
    """Numbers from 1 of 128-bit hashes, equal for equal ones, in their order."""
    high, low = np.frombuffer(hashes, ">u8").reshape(-1, 2).T.astype(np.uint64)
    order = np.lexsort((low, high))
    new = np.ones(order.size, dtype=np.int64)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    out = np.empty(order.size, dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def _recombined(outer: DataFrame) -> DataFrame:
    """Whole nodes from the parts that shards have of them.

    A node in one shard has its whole subtree there. One in several was counted as a
    child by each of them, as a leaf by those that have nothing longer, and its last text
    was taken off once by each; that is put right for it and all nodes above it.
    """
    met = outer.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.first("chars").alias("chars"),
        F.count("*").alias("parts"), F.count_if(F.col("children") == 0).alias("bare"), F.max("ends").alias("ends"),
        F.min("least").alias("least"), *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")),
    )
    met = stored(met, "met")
    kept = ["key", "parent_key", "depth", "least", "n", "children", "leaves", "saved", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        rows.sort(key=lambda r: -r["depth"])
        by_key = {r["key"]: r for r in rows}
        more = {k: [0, 0] for k in by_key}  # of the subtree: leaves too many, savings missing
        for r in rows:
            leaves, saved = more[r["key"]]
            leaves, saved = leaves + r["bare"], saved + (r["parts"] - 1) * r["chars"]
            r["leaves"] -= leaves
            r["saved"] += saved
            if r["parent_key"] is not None:
                above = more[r["parent_key"]]
                above[0] += leaves
                above[1] += saved
                by_key[r["parent_key"]]["children"] -= r["parts"] - 1
        if rows:
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in kept} for r in rows], schema=schema)

    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.string()]
    schema = pa.schema(list(zip(kept, kinds)))
    several = met.where(F.col("parts") > 1).repartition(1)
    mended = several.mapInArrow(run, met.select(*kept).schema)
    return met.where(F.col("parts") == 1).select(*kept).unionByName(mended)
