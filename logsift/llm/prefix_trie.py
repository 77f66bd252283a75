"""Prefix trie of conversations from sorted matrices of turn ids.

A conversation is the sequence of the ids of its turns, 128 bits of a hash of
role and text. Conversations are range-partitioned and sorted by that sequence,
so every node, a distinct prefix, is a run of neighbouring rows. A task cuts
its sorted rows into blocks, each a matrix with a column per depth, padded with
-1. After a numpy lexsort of the columns, marks of where a column changes from row to row,
OR-accumulated over the columns, are the starts of the nodes of each depth, and
``reduceat`` over the starts aggregates every depth; sums over subtrees go up
from the deepest column.

A node that touches the first or last row of its block may go on in the next
one. Such open nodes, a path from the root per block edge, are passed on with the sums of what
lies closed below them, and recombined by the hash of their prefix: block by
block within a task, then over ``FAN_IN`` neighbouring shards at a time until one
is left. In each step nodes that no longer touch an edge are closed. The ids of
conversations that end in open nodes are gathered by a shuffle and hashed as a stream, so
a conversation with any share of all copies is never held.

``rebuild`` gives conversations that share prefixes: the first h turns of
conversation c - c % 100, then c's own turns after its first h, h = crc32(c) % 6.

Defined results: turns are ordered by number, null first; turns of equal number by their
id, a fixed order; repeated rows are repeated turns; a null role or text is
empty; rows without conv_id are in no conversation; a conversation with no
turns left ends in the root; an empty table gives no rows; other columns are not read.
Texts are hashed where they are read and go no further. A conversation is one row of 16 bytes
and a length per turn; blocks hold ``CELLS`` cells, or one longer conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.session import cut_lineage

CELLS = 1 << 18  # of a block's matrix
FAN_IN = 64
ID = 32  # hexadecimal digits of a turn's id
EMPTY = hashlib.sha256(b"").hexdigest()
#: kind 0: a node with all its results; 1: an open node; 2: a conversation (first) that ends in an open node (key).
NODE = ("kind int, shard int, key string, parent string, depth long, first long, parent_first long, n long, children long, "
        "leaves long, saved long, chars long, left boolean, right boolean, ends string")
NAMES = [c.split()[0] for c in NODE.split(", ")]
OPEN = [c for c in NAMES if c not in ("kind", "shard", "parent_first", "ends")]


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (id, chars)."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    key = F.substring(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256), 1, ID)
    one = F.struct(F.col(turn).alias("turn"), key.alias("id"), F.length(t).cast("long").alias("chars"))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), one.alias("one"))
    g = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"))
    return g.select("conv_id", F.transform("all", lambda x: F.struct(x["id"].alias("id"), x["chars"].alias("chars"))).alias("turns"))


def rebuild(convs: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, turns) after each conversation takes its first turns from the first one of its block."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    first = convs.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads).alias("head"))
    j = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).withColumn("h", h).join(first, "base", "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.lit(0), F.size("turns") - F.col("h")))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return j.select("conv_id", F.concat(head, own).alias("turns"))


def _prefixes(path: bytes) -> list[str]:
    """Keys of the prefixes of a path, the root first."""
    h = hashlib.sha256()
    out = [h.hexdigest()[:ID]]
    for i in range(0, len(path), ID):
        h.update(path[i:i + ID])
        out.append(h.copy().hexdigest()[:ID])
    return out


def _block(conv: np.ndarray, first: np.ndarray, ids: np.ndarray, chars: np.ndarray) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(closed nodes, open nodes, ends in open nodes) of a block of rows; row i has items first[i]:first[i + 1]."""
    size = np.diff(first)
    wide, n = int(size.max()), len(size)
    _, number = np.unique(ids, return_inverse=True)
    col = np.arange(len(ids)) - np.repeat(first[:-1], size)
    matrix = np.full((n, wide), -1, dtype=np.int64)
    matrix[np.repeat(np.arange(n), size), col] = number
    order = np.lexsort((conv, *matrix.T[::-1]))
    matrix, conv, size, first = matrix[order], conv[order], size[order], first[:-1][order]
    new = np.ones((n, wide + 1), dtype=bool)  # column d: row starts another prefix of d turns
    new[1:, 0] = False
    new[1:, 1:] = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1)
    edge = [_prefixes(ids[first[i]:first[i] + size[i]].tobytes()) for i in (0, n - 1)]
    closed, opened, ends = [], [], []
    below = (np.zeros(n, dtype=np.int64),) * 3  # children, leaves and saved of nodes one deeper, at their first rows
    upper: dict[int, list] = {}
    for d in range(wide, -1, -1):
        start = np.flatnonzero(new[:, d])
        stop = np.append(start[1:], n)
        real = size[start] >= d
        least = np.minimum.reduceat(conv, start)
        children, leaves, saved = (np.add.reduceat(x, start) for x in below)
        deepest = np.maximum.reduceat(size, start)
        start, stop, least, children, leaves, saved, deepest = (x[real] for x in (start, stop, least, children, leaves, saved, deepest))
        count = stop - start
        text = chars[first[start] + d - 1] if d else np.zeros(len(start), dtype=np.int64)
        left, right = start == 0, stop == n
        whole = ~(left | right)
        full = leaves + (whole & (deepest == d)), saved + np.where(whole, (count - 1) * text, 0)
        below = tuple(np.zeros(n, dtype=np.int64) for _ in range(3))
        for x, y in zip(below, (np.ones(len(start), dtype=np.int64), *full), strict=True):
            x[start[whole]] = y[whole]
        # Parents of closed nodes one deeper.
        for row in upper.pop(d + 1, []):
            at = int(np.searchsorted(start, row[0], side="right")) - 1
            if whole[at]:
                row[1][6] = int(least[at])
            else:
                row[1][3] = edge[0][d] if left[at] else edge[1][d]
        kept = upper[d] = []
        finished = size == d
        for i in np.flatnonzero(whole):
            a = int(start[i])
            own = conv[a:stop[i]][finished[a:stop[i]]]
            digest = hashlib.sha256(",".join(map(str, own.tolist())).encode()).hexdigest() if len(own) else EMPTY
            closed.append([0, None, None, None, d, int(least[i]), None, int(count[i]), int(children[i]), int(full[0][i]), int(full[1][i]), None, None, None, digest])
            kept.append((a, closed[-1]))
        for i in np.flatnonzero(~whole):
            a, side = int(start[i]), 0 if left[i] else 1
            key = edge[side][d]
            opened.append((key, edge[side][d - 1] if d else None, d, int(least[i]), int(count[i]), int(children[i]), int(leaves[i]), int(saved[i]), int(text[i]),
                           bool(left[i]), bool(right[i])))
            ends += [(key, c) for c in conv[a:stop[i]][finished[a:stop[i]]].tolist()]
    return closed, opened, ends


def _merge(blocks: list[pd.DataFrame], last: bool = False) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(closed, open) nodes of neighbouring blocks' open nodes; with ``last`` there is nothing beside them, and all are closed."""
    parts = []
    for i, b in enumerate(blocks):
        parts.append(b.assign(left=b["left"] & (i == 0), right=b["right"] & (i == len(blocks) - 1)))
    g = pd.concat(parts, ignore_index=True).groupby("key", sort=False, dropna=False)
    nodes = g.agg(parent=("parent", "first"), depth=("depth", "first"), first=("first", "min"), n=("n", "sum"), children=("children", "sum"),
                  leaves=("leaves", "sum"), saved=("saved", "sum"), chars=("chars", "first"), left=("left", "any"), right=("right", "any")).reset_index()
    done = np.full(len(nodes), last) | ~(nodes["left"] | nodes["right"]).to_numpy()
    place = {k: i for i, k in enumerate(nodes["key"])}
    up = np.array([place.get(p, -1) for p in nodes["parent"]], dtype=np.int64)
    depth, children, leaves, saved = (nodes[c].to_numpy().copy() for c in ("depth", "children", "leaves", "saved"))
    own = ((nodes["n"] - 1) * nodes["chars"]).to_numpy()
    for d in range(int(depth.max(initial=0)), -1, -1):
        at = np.flatnonzero(done & (depth == d))
        leaves[at] += children[at] == 0
        saved[at] += own[at]
        at = at[up[at] >= 0]
        for total, value in ((children, np.ones(len(at), dtype=np.int64)), (leaves, leaves[at]), (saved, saved[at])):
            np.add.at(total, up[at], value)
    nodes = nodes.assign(children=children, leaves=leaves, saved=saved)
    return nodes[done], nodes[~done]


def _out(kind: int, shard: int, nodes: pd.DataFrame) -> pa.RecordBatch:
    got = {"kind": [kind] * len(nodes), "shard": [shard] * len(nodes)} | {c: nodes[c].tolist() for c in OPEN}
    return _batch([got.get(c, [None] * len(nodes)) for c in NAMES])


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[c.split()[1]]) for v, c in zip(columns, NODE.split(", "), strict=True)], NAMES)


def _blocks(first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows whose padded matrix has ``CELLS`` cells at most, or one row."""
    size, a = np.diff(first), 0
    while a < len(size):
        wide = np.maximum.accumulate(size[a:]) + 1
        z = a + max(1, int(np.searchsorted(wide * np.arange(1, len(wide) + 1), CELLS, side="right")))
        yield a, z
        a = z


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard's sorted rows: closed ones, its open ones, and ends in those that were open in a block."""
    shard, rest = TaskContext.get().partitionId(), None
    for b in batches:
        t, conv = b["turns"], b["conv_id"].to_numpy()
        first = t.offsets.to_numpy().astype(np.int64)
        items, first = t.flatten(), first - first[0] if len(first) else first
        ids = np.array(items.field(0).to_pylist(), dtype=f"S{ID}") if len(items) else np.empty(0, dtype=f"S{ID}")
        chars = items.field(1).to_numpy(zero_copy_only=False)
        for a, z in _blocks(first):
            lo, hi = first[a], first[z]
            closed, opened, ends = _block(conv[a:z], first[a:z + 1] - lo, ids[lo:hi], chars[lo:hi])
            if closed:
                yield _batch(list(zip(*closed, strict=True)))
            if ends:
                none = [None] * len(ends)
                yield _batch([[2] * len(ends), none, [k for k, _ in ends], none, none, [c for _, c in ends], *[none] * 9])
            opened = pd.DataFrame(opened, columns=OPEN)
            if rest is None:
                rest = opened
                continue
            merged, rest = _merge([rest, opened])
            if len(merged):
                yield _out(1, -1, merged)
    if rest is not None:
        yield _out(1, shard, rest)


def _recombine(last: bool, fan_in: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The open nodes of neighbouring shards, as those of one shard and closed ones (shard -1)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        blocks = [g[OPEN] for _, g in group.sort_values("shard", kind="stable").groupby("shard")]
        closed, still = _merge(blocks, last)
        out = pd.concat([closed.assign(shard=-1), still.assign(shard=int(group["shard"].min()) // fan_in)], ignore_index=True)
        return out[["shard", *OPEN]]

    return run


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends) of rows sorted by (key, first): SHA-256 of the ids, comma-joined, as they come."""
    at, h = None, None

    def done(keys: list, h) -> None:
        keys.append((at, h.hexdigest()))

    for b in batches:
        out, keys = [], b["key"].to_pylist()
        ids = b["first"].to_pylist()
        a = 0
        while a < len(keys):
            z = a
            while z < len(keys) and keys[z] == keys[a]:
                z += 1
            if keys[a] != at:
                if h is not None:
                    done(out, h)
                at, h = keys[a], hashlib.sha256()
            else:
                h.update(b",")
            h.update(",".join(map(str, ids[a:z])).encode())
            a = z
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([v for _, v in out], pa.string())], ["key", "ends"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([h.hexdigest()], pa.string())], ["key", "ends"])


def trie(convs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row per node of the trie of ``convs`` (conv_id, turns array of (id, chars))."""
    spark = convs.sparkSession
    rows = convs.repartitionByRange("turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    table = cut_lineage(rows.mapInArrow(_shard, NODE), "trie_nodes")
    kept = ["shard", *OPEN]
    kind = ", ".join(c for c in NODE.split(", ") if c.split()[0] in kept)
    opened = table.where("kind = 1").select(*kept)
    closed, still = opened.where("shard < 0"), opened.where("shard >= 0")
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    while True:
        last = shards <= fan_in
        shards = -(-shards // fan_in)
        got = still.groupBy(F.floor(F.col("shard") / fan_in).alias("neighbours")).applyInPandas(_recombine(last, fan_in), kind)
        got = cut_lineage(got, "trie_edges")
        closed, still = closed.unionByName(got.where("shard < 0")), got.where("shard >= 0")
        if last:
            break
    # Ends of nodes that were open in a block, and parents that were.
    ended = table.where("kind = 2").select("key", "first").repartition("key").sortWithinPartitions("key", "first")
    closed = closed.join(ended.mapInArrow(_hash_ends, "key string, ends string"), "key", "left").fillna(EMPTY, ["ends"])
    parents = closed.select(F.col("key").alias("parent"), F.col("first").alias("up"))
    edge = closed.join(parents, "parent", "left").withColumn("parent_first", F.col("up"))
    inner = table.where("kind = 0").join(parents, "parent", "left").withColumn("parent_first", F.coalesce("parent_first", "up"))
    cols = [F.col("first").alias("conv_id"), "depth", F.col("parent_first").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
            F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    return inner.select(*cols).unionByName(edge.select(*cols))


def op13(conversations: DataFrame) -> DataFrame:
    return trie(rebuild(cut_lineage(turns(conversations), "turns")))
