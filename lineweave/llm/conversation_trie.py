"""Prefix trie of conversations: balanced parentheses per shard, spines merged across shards.

Every turn is known by 128 bits of the SHA-256 of its role and text; a conversation is the string of its turns'
keys, 16 bytes each, so that byte order is the order of the trie. Rows are range-partitioned by (string, id):
copies of one conversation, and conversations with one common beginning, spread over as many shards as they need.

A shard reads its rows once, in order, and writes its part of the trie as balanced parentheses. ``find_close`` over
a range min-max tree of excess blocks delimits subtrees; a rank over ``()`` pairs counts leaves; cumulative arrays
over preorder give savings, over strings members. A node lies in several shards only if it is on the path to
the shard's first or last string (its spine). All figures are additive when a node counts as new in the first shard
that holds it and as a leaf in the last, so a shard has to know how many turns it shares with its neighbours, one row
a shard, and nothing else. Spine rows are added up by the hash of their path; the others are final.

Defined results: null role and text count as empty; turns go by turn (null first), equal ones by their keys, and
repeated rows are turns of their own; rows with a null id belong to no conversation; ids of an integer type; an empty table
has no root, as it has no member. Other columns are not read. A conversation is one row of 24 bytes a turn.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.session import checkpointed, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

KEY = 16  # bytes a turn
BLOCK = 64  # parentheses a block
SHARD_TURNS = 500_000
WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()
COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def rebuilt(conversations: DataFrame, family: int = 20, shares: int = 4) -> DataFrame:
    """``conv_id, keys, words``: the first h turns of conversation c - c % family, then c's own after its first h.

    h is crc32(c) % shares. The conversations of one family (``family`` ids at most) meet in one task; one shuffle.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))
    own = (turns.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(family))).repartition("base")
           .groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "words"))).alias("turns")))
    families = own.groupBy("base").agg(F.collect_list(F.struct("conv_id", "turns")).alias("convs")).withColumn(
        "head", F.slice(F.flatten(F.transform(F.filter("convs", lambda c: c["conv_id"] == F.col("base")), lambda c: c["turns"])),
                        1, shares - 1))
    h = (F.crc32(F.col("c.conv_id").cast("string").cast("binary")) % shares).cast("int")
    whole = F.concat(F.slice("head", F.lit(1), h), F.slice("c.turns", h + 1, F.size("c.turns")))
    return families.select("head", F.explode("convs").alias("c")).select(F.col("c.conv_id").alias("conv_id"), whole.alias("t")).select(
        "conv_id", F.unhex(F.array_join(F.transform("t", lambda t: t["key"]), "")).alias("keys"),
        F.transform("t", lambda t: t["words"]).alias("words"))


# --- one shard ------------------------------------------------------------------------------------------------


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two strings have in common at their beginnings."""
    low, high = 0, min(len(a), len(b)) // KEY
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * KEY:mid * KEY] == b[low * KEY:mid * KEY]:
            low = mid
        else:
            high = mid - 1
    return low


def find_close(bits: np.ndarray, excess: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Position of the closing parenthesis of each opening one: the next place whose excess is lower by one.

    Looks through the rest of the own block, then climbs the tree of block minima to the first later block that
    gets down to the excess wanted, descends to it, and looks through that block.
    """
    n_blocks = 1 << max(0, (math.ceil(len(bits) / BLOCK) - 1).bit_length())
    far = np.iinfo(np.int64).max
    grid = np.full(n_blocks * BLOCK, far, np.int64)
    grid[:len(excess)] = excess
    low = np.full(2 * n_blocks, far, np.int64)
    low[n_blocks:] = grid.reshape(n_blocks, BLOCK).min(axis=1)
    for level in range(n_blocks.bit_length() - 1, 0, -1):
        at = np.arange(1 << (level - 1), 1 << level)
        low[at] = np.minimum(low[2 * at], low[2 * at + 1])

    close, wanted = np.full(len(opens), -1, np.int64), excess[opens] - 1

    def scan(which: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Looks from ``start`` to the end of its block; the queries that are still open."""
        place = start.copy()
        inside = place % BLOCK != 0
        while len(which):
            found = inside & (grid[np.minimum(place, len(grid) - 1)] == wanted[which])
            close[which[found]] = place[found]
            go_on = ~found & inside
            if not go_on.any():
                break
            place = np.where(go_on, place + 1, place)
            inside = go_on & (place % BLOCK != 0)
        return which[close[which] < 0]

    left = scan(np.arange(len(opens)), opens + 1)
    node = n_blocks + opens[left] // BLOCK + 1
    while (higher := low[node] > wanted[left]).any():
        node = np.where(higher, np.where(node % 2 == 1, (node + 1) // 2, node + 1), node)
    while (inner := node < n_blocks).any():
        child = 2 * node
        child = np.where(low[np.minimum(child, 2 * n_blocks - 1)] > wanted[left], child + 1, child)
        node = np.where(inner, child, node)
    begin = (node - n_blocks) * BLOCK
    rows = grid[begin[:, None] + np.arange(BLOCK)] == wanted[left][:, None] if len(left) else np.zeros((0, BLOCK), bool)
    close[left] = begin + rows.argmax(axis=1)
    return close


class Shard:
    """The trie of sorted rows, as balanced parentheses, and the figures of its nodes in preorder.

    ``back`` and ``ahead`` are the turns shared with the last string before and the first one after, -1 if there is none.
    """

    def __init__(self, keys: list[bytes], ids: np.ndarray, words: list, back: int = -1, ahead: int = -1):
        starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        self.keys, self.back, self.ahead = [keys[i] for i in starts], back, ahead
        self.ids = np.split(ids, starts[1:])
        length = np.array([len(k) // KEY for k in self.keys])
        common = np.array([0, *(shared_turns(a, b) for a, b in zip(self.keys, self.keys[1:], strict=False))])
        made = length - common
        first = 1 + np.cumsum(made) - made  # first new node of each string; node 0 is the root
        count = 1 + int(made.sum())
        self.string = np.concatenate(([0], np.repeat(np.arange(len(made)), made)))
        self.depth = np.concatenate(([0], np.arange(1, count) - np.repeat(first, made) + np.repeat(common, made) + 1))
        self.words = np.concatenate([[0], *(np.asarray(words[i][c:], np.int64) for i, c in zip(starts, common, strict=True))])
        self.parent, path = np.arange(-1, count - 1), [0]
        self.end = np.empty(len(made), np.int64)
        for i, (c, m, f) in enumerate(zip(common.tolist(), made.tolist(), first.tolist(), strict=True)):
            del path[c + 1:]
            if m:
                self.parent[f] = path[c]
                path.extend(range(f, f + m))
            self.end[i] = path[-1]
        self.last_path = path
        # runs of the parentheses: the root, then for each string what it closes and what it opens, then the rest
        closes = np.concatenate((length[:-1] - common[1:], [length[-1] + 1]))
        runs = np.stack((made, closes), axis=1).ravel()
        self.bits = np.concatenate(([1], np.repeat(np.tile([1, 0], len(made)), runs)))
        self._figures()

    def _figures(self) -> None:
        bits, opens = self.bits, np.flatnonzero(self.bits)
        close = find_close(bits, np.cumsum(2 * bits - 1), opens)
        last = np.arange(len(opens)) + (close - opens + 1) // 2 - 1  # last node of the subtree, in preorder
        pairs = (bits[:-1] == 1) & (bits[1:] == 0)
        if self.ahead >= self.depth[self.end[-1]]:  # the next shard goes on below, or holds more of the same
            pairs[opens[self.end[-1]]] = False
        rank = np.concatenate(([0], np.cumsum(pairs)))
        self.n_leaves = rank[close] - rank[opens]
        held = np.concatenate(([0], np.cumsum([len(i) for i in self.ids])))
        low, high = self.string, self.string[last] + 1
        self.n_convs = held[high] - held[low]
        smallest = np.concatenate(([i[0] for i in self.ids], [np.iinfo(np.int64).max]))
        self.conv_id = np.minimum.reduceat(smallest, np.stack((low, high), axis=1).ravel())[::2]
        self.new = np.arange(len(opens)) > self.back
        total = np.concatenate(([0], np.cumsum((self.n_convs - self.new) * self.words)))
        self.saved_tokens = total[last + 1] - total[:-1]
        self.n_children = np.bincount(self.parent[1:][self.new[1:]], minlength=len(opens))

    def spine(self) -> dict[int, bytes]:
        """Nodes that other shards hold too, by the hash of their path."""
        out = {}
        for key, nodes in ((self.keys[0], range(self.back + 1)), (self.keys[-1], self.last_path[:self.ahead + 1])):
            path = hashlib.sha256()
            for d, node in enumerate(nodes):
                path.update(key[(d - 1) * KEY:d * KEY] if d else b"")
                out[node] = path.digest()
        return out

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        spine, count = self.spine(), len(self.depth)
        in_spine = np.zeros(count, bool)
        in_spine[list(spine)] = True
        below = np.concatenate(([False], in_spine[self.parent[1:]]))
        ends = [NO_ENDS] * count
        pieces = {}
        for node, ids in zip(self.end.tolist(), self.ids, strict=True):
            piece = ",".join(map(str, ids.tolist()))
            if in_spine[node]:
                pieces[node] = piece
            else:
                ends[node] = hashlib.sha256(piece.encode()).hexdigest()
        parent = np.where(below, 0, self.conv_id[self.parent])
        hidden = below | (np.arange(count) == 0)
        step = 50_000
        for a in range(0, count, step):
            at = range(a, min(a + step, count))
            cut = slice(a, at.stop)
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.conv_id[cut]), pa.array(self.depth[cut]), pa.array(parent[cut], mask=hidden[cut]),
                 *(pa.array(getattr(self, c)[cut].astype(np.int64)) for c in COUNTS), pa.array(ends[cut], pa.string()),
                 pa.array([spine.get(v) for v in at], pa.binary()),
                 pa.array([spine[p] if b else None for p, b in zip(self.parent[cut].tolist(), below[cut], strict=True)], pa.binary()),
                 pa.array([pieces.get(v) for v in at], pa.string()), pa.array([shard] * len(at), pa.int32())],
                ["conv_id", "depth", "parent_conv_id", *COUNTS, "ends_sha256", "path", "parent_path", "piece", "shard"])


NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", ends_sha256 string"
OUTPUT = ["conv_id", "depth", "parent_conv_id", *COUNTS, "ends_sha256"]


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if table is not None:
        shard, back, ahead = (table.column(c)[0].as_py() for c in ("shard", "back", "ahead"))
        yield from Shard(table.column("keys").to_pylist(), table.column("conv_id").to_numpy(), table.column("words").to_pylist(),
                         back, ahead).rows(shard)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        before, first, last, after = (batch.column(i).to_pylist() for i in range(1, 5))
        both = [[-1 if x is None or y is None else shared_turns(x, y) for x, y in zip(xs, ys, strict=True)]
                for xs, ys in ((before, first), (last, after))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in both)], ["shard", "back", "ahead"])


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by path and shard to one hash a path, without holding the pieces."""
    path, total = None, None
    for batch in batches:
        for at, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if at != path:
                if path is not None:
                    yield pa.RecordBatch.from_pydict({"ends_path": pa.array([path], pa.binary()), "joined": [total.hexdigest()]})
                path, total = at, hashlib.sha256(piece.encode())
            else:
                total.update(b"," + piece.encode())
    if path is not None:
        yield pa.RecordBatch.from_pydict({"ends_path": pa.array([path], pa.binary()), "joined": [total.hexdigest()]})


# --- all shards -----------------------------------------------------------------------------------------------


def prefix_trie(sequences: DataFrame, shards: int) -> DataFrame:
    """The nodes of the trie over rows ``conv_id, keys, words``, worked out in ``shards`` ranges."""
    # The checkpoint holds the ranges still, also when an executor is lost.
    ranges = checkpointed(sequences.repartitionByRange(shards, "keys", "conv_id").sortWithinPartitions("keys", "conv_id"))
    ranges = ranges.withColumn("shard", F.spark_partition_id())
    edges = ranges.groupBy("shard").agg(F.min("keys").alias("first"), F.max("keys").alias("last"))
    in_order = Window.orderBy("shard")  # one row a shard
    neighbours = edges.select("shard", F.lag("last").over(in_order).alias("before"), "first", "last",
                              F.lead("first").over(in_order).alias("after")).mapInArrow(_neighbours, "shard int, back bigint, ahead bigint")
    nodes = stored(ranges.join(F.broadcast(neighbours), "shard").mapInArrow(
        _shard_nodes, f"{NODE}, path binary, parent_path binary, piece string, shard int"), "trie-shards")
    spine = nodes.filter("path is not null")
    ends = (spine.filter("piece is not null").select("path", "piece", "shard").repartition("path")
            .sortWithinPartitions("path", "shard").mapInArrow(_join_pieces, "ends_path binary, joined string"))
    merged = stored(spine.groupBy("path").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.first("parent_path").alias("parent_path"),
        *(F.sum(c).alias(c) for c in COUNTS)).join(ends, F.col("path") == F.col("ends_path"), "left")
        .select("path", "conv_id", "depth", "parent_path", *COUNTS, F.coalesce("joined", F.lit(NO_ENDS)).alias("ends_sha256")), "trie-spine")
    above = merged.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("parent_conv_id"))
    inner = nodes.filter("path is null")
    return (inner.filter("parent_path is null").select(*OUTPUT)
            .unionByName(inner.filter("parent_path is not null").drop("parent_conv_id").join(above, "parent_path").select(*OUTPUT))
            .unionByName(merged.join(above, "parent_path", "left").select(*OUTPUT)))


def conversation_trie(conversations: DataFrame, family: int = 20, shares: int = 4, shards: int | None = None) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``: a row a node."""
    if shards is None:
        shards = max(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                     math.ceil(conversations.count() / SHARD_TURNS))
    return prefix_trie(rebuilt(conversations, family, shares), shards)
