"""Prefix trie over conversations: which beginnings are shared, and what sharing them saves.

1. Turns get dictionary ids: the distinct (role, text) digests are numbered once, and only ids and sizes travel on.
2. Conversations are rebuilt as arrays of ids and equal ones are collapsed, with the digest of their members' ids.
3. The distinct sequences are range-partitioned. Every shard inserts its sorted sequences medians first into a ternary
   search tree and walks it once, children before parents, for members, leaves and savings.
4. Only nodes on a shard's first and last sequence can reach into other shards. They leave the shard as two paths per
   shard, without what their boundary children hold, and are merged in one more tree over these paths.

No group of conversations is gathered: copies collapse before the shards, a common beginning is spread over as many shards
as it has sequences, and ids of equal conversations meet in packs of a bounded number, hashed as they stream by.

Odd input: rows without a conversation id are left out; a null role or text is empty. Turns are ordered by turn, null
first, ties by role and then by the SHA-256 of the text; equal rows are turns of their own. Texts of any length travel as
digests. A conversation must fit one row as an array of ids. An empty table gives no nodes. Only the four named columns
are read, so other columns, whatever their names, change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.store import keep

FAMILY, HEADS = 5, 9
#: Turns per shard: the size of a tree in a task. Ids per pack: what is joined before the digest streams over the packs.
SHARD_TURNS, PACK_IDS = 1 << 17, 1 << 12
NO_ENDS = hashlib.sha256(b"").hexdigest()

_ENDS = "seq array<bigint>, sizes array<bigint>, conv_id bigint, n bigint, ends string"
_NODES = (
    "shard int, path int, depth bigint, conv_id bigint, up int, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint,"
    " saved_tokens bigint, ends string, turn bigint, size bigint"
)


def encoded(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, id, size``: turns with dictionary ids in the place of their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    light = turns.where("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("size")
    )
    named = light.groupBy("role", "digest").count().select(F.col("role").alias("_role"), F.col("digest").alias("_digest"))
    dictionary = keep(named.withColumn("id", F.monotonically_increasing_id()), "trie-dictionary")
    same = (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    return light.join(dictionary, same).drop("_role", "_digest")


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, seq, sizes``: every conversation as ordered dictionary ids and text sizes."""
    listed = encoded(turns).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "id", "size"))).alias("t"))
    return listed.select("conv_id", F.col("t.id").alias("seq"), F.col("t.size").alias("sizes"))


def head_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt(own: DataFrame) -> DataFrame:
    """Every conversation with its first turns taken from the first one of its family of five ids."""
    base = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("_base"), F.col("seq").alias("_seq"), F.col("sizes").alias("_sizes"))
    h = head_length(F.col("conv_id"))
    joined = own.withColumn("_h", h).join(base, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("_base"), "left")

    def spliced(mine: str, first: str) -> Column:
        head = F.coalesce(F.slice(first, F.lit(1), F.col("_h")), F.array().cast("array<bigint>"))
        return F.concat(head, F.slice(mine, F.col("_h") + 1, F.size(mine))).alias(mine)

    return joined.select("conv_id", spliced("seq", "_seq"), spliced("sizes", "_sizes"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by sequence and pack: one row per sequence, its ids hashed pack by pack."""
    seq, sizes, first, n, digest = None, None, None, 0, None
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*out, strict=True)]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["seq", "sizes", "conv_id", "n", "ends"])
        out.clear()
        return made

    for batch in batches:
        columns = (batch.column(name).to_pylist() for name in ("seq", "sizes", "first_id", "n", "ids"))
        for next_seq, next_sizes, next_first, next_n, ids in zip(*columns, strict=True):
            if next_seq != seq:
                if seq is not None:
                    out.append((seq, sizes, first, n, digest.hexdigest()))
                seq, sizes, first, n, digest = next_seq, next_sizes, next_first, 0, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
            n += next_n
        if len(out) >= 4096:
            yield flush()
    if seq is not None:
        out.append((seq, sizes, first, n, digest.hexdigest()))
    if out:
        yield flush()


def _packs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by sequence and id: runs of one sequence as ids joined to packs of at most ``limit``."""
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
    names = ["seq", "sizes", "first_id", "n", "ids"]
    for batch in batches:
        out: list[tuple] = []
        seq, sizes, ids = None, None, []
        for next_seq, next_sizes, conv_id in zip(*(batch.column(name).to_pylist() for name in ("seq", "sizes", "conv_id")), strict=True):
            if ids and (next_seq != seq or len(ids) == limit):
                out.append((seq, sizes, ids[0], len(ids), ",".join(map(str, ids))))
                ids = []
            seq, sizes = next_seq, next_sizes
            ids.append(conv_id)
        if ids:
            out.append((seq, sizes, ids[0], len(ids), ",".join(map(str, ids))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def distinct_sequences(rows: DataFrame, pack: int = PACK_IDS) -> DataFrame:
    """``seq, sizes, conv_id, n, ends``: distinct sequences with smallest id, number and digest of their conversations.

    Rows are dealt by ranges of sequence and id, so copies of one conversation fill as many tasks as they need; what then
    meets per sequence is packs of ids, whose digest is a stream in the order of the ids.
    """
    dealt = rows.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    packs = dealt.mapInArrow(lambda batches: _packs(batches, pack), "seq array<bigint>, sizes array<bigint>, first_id bigint, n bigint, ids string")
    return packs.repartition("seq").sortWithinPartitions("seq", "first_id").mapInArrow(_digests, _ENDS)


class SearchTree:
    """Ternary search tree over sequences of integers; its nodes are the nodes of the trie, parents before children."""

    def __init__(self) -> None:
        self.key, self.size, self.low, self.high, self.child = [None], [0], [0], [0], [0]
        self.parent, self.depth = [0], [0]

    def _new(self, key: int, size: int, parent: int) -> int:
        for column, value in zip((self.key, self.size, self.low, self.high, self.child, self.parent, self.depth),
                                 (key, size, 0, 0, 0, parent, self.depth[parent] + 1), strict=True):
            column.append(value)
        return len(self.key) - 1

    def insert(self, seq: Sequence[int], sizes: Sequence[int]) -> list[int]:
        """The nodes of ``seq`` from the root down; missing ones are made."""
        key, low, high, child = self.key, self.low, self.high, self.child
        here, path = 0, [0]
        for k, size in zip(seq, sizes, strict=True):
            at = child[here]
            if not at:
                child[here] = at = self._new(k, size, here)
            while key[at] != k:
                side = low if k < key[at] else high
                if not side[at]:
                    side[at] = self._new(k, size, here)
                at = side[at]
            here = at
            path.append(at)
        return path

    @classmethod
    def balanced(cls, seqs: Sequence[Sequence[int]], sizes: Sequence[Sequence[int]]) -> tuple[SearchTree, list[int]]:
        """A tree of sorted sequences inserted medians first, and the end node of each."""
        tree, ends = cls(), [0] * len(seqs)
        todo = [(0, len(seqs))]
        while todo:
            lo, hi = todo.pop()
            if lo < hi:
                mid = (lo + hi) // 2
                ends[mid] = tree.insert(seqs[mid], sizes[mid])[-1]
                todo += [(mid + 1, hi), (lo, mid)]
        return tree, ends

    def path(self, node: int) -> list[int]:
        found = [node]
        while node:
            found.append(node := self.parent[node])
        return found[::-1]


class Totals:
    """What a node counts: members, the smallest, children, leaves, savings and the digest of those that end there."""

    def __init__(self, tree: SearchTree) -> None:
        n = len(tree.key)
        self.tree, self.members, self.first, self.children, self.leaves, self.saved = tree, [0] * n, [None] * n, [0] * n, [0] * n, [0] * n
        self.ends: list[str | None] = [None] * n

    def add(self, node: int, members: int, first: int | None, ends: str | None) -> None:
        self.members[node] += members
        if first is not None and (self.first[node] is None or first < self.first[node]):
            self.first[node] = first
        self.ends[node] = self.ends[node] or ends

    def roll_up(self, open_nodes: frozenset[int] = frozenset()) -> None:
        """Children into parents, last made first. An open node is left as it stands and adds nothing to its parent."""
        parent, size = self.tree.parent, self.tree.size
        for node in range(len(parent) - 1, -1, -1):
            if node in open_nodes:
                continue
            if not self.children[node]:
                self.leaves[node] = 1
            self.saved[node] += (self.members[node] - 1) * size[node]
            if node:
                up = parent[node]
                self.children[up] += 1
                self.leaves[up] += self.leaves[node]
                self.saved[up] += self.saved[node]
                self.add(up, self.members[node], self.first[node], None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.int64(), pa.int64()]
    names = [part.strip().split()[0] for part in _NODES.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _in_blocks(rows: Iterator[tuple], size: int = 8192) -> Iterator[pa.RecordBatch]:
    block: list[tuple] = []
    for row in rows:
        block.append(row)
        if len(block) == size:
            yield _batch(block)
            block = []
    if block:
        yield _batch(block)


def _shard_nodes(shard: int, seqs: list, sizes: list, firsts: list, counts: list, digests: list) -> Iterator[tuple]:
    """Rows of one shard: settled nodes (``path`` null) and the two boundary paths, ``up`` naming an unsettled parent's path."""
    tree, ends = SearchTree.balanced(seqs, sizes)
    totals = Totals(tree)
    for node, first, n, digest in zip(ends, firsts, counts, digests, strict=True):
        totals.add(node, n, first, digest)
    side = {node: 1 for node in tree.path(ends[-1])} | {node: 0 for node in tree.path(ends[0])}
    totals.roll_up(frozenset(side))
    for node in range(len(tree.key)):
        up = tree.parent[node]
        path = side.get(node)
        unsettled = path is None and up in side
        parent = None if path is not None or unsettled else totals.first[up]
        yield (shard, path, tree.depth[node], totals.first[node], side[up] if unsettled else None, parent, totals.members[node],
               totals.children[node], totals.leaves[node], totals.saved[node], totals.ends[node], tree.key[node], tree.size[node])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    columns: dict[str, list] = {name: [] for name in ("seq", "sizes", "conv_id", "n", "ends")}
    for batch in batches:
        for name, values in columns.items():
            values += batch.column(name).to_pylist()
    if columns["seq"]:
        yield from _in_blocks(_shard_nodes(TaskContext.get().partitionId(), *columns.values()))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boundary paths of all shards in one tree: final nodes (``path`` null), and per shard and path each depth's smallest id."""
    rows = [row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(len(batch.schema.names))), strict=True)]
    rows.sort(key=lambda r: (r[0], r[2], r[1]))
    paths: dict[tuple[int, int], list[tuple]] = {}
    for row in rows:
        paths.setdefault((row[0], row[1]), []).append(row)
        if row[1] == 0:
            paths.setdefault((row[0], 1), [])
    whole = {}
    for (shard, side), own in paths.items():
        shared = paths[shard, 0][: own[0][2]] if side and own else []
        whole[shard, side] = [r[11] for r in [*shared, *own]][1:], [r[12] for r in [*shared, *own]][1:]
    keys = sorted(whole, key=lambda k: whole[k][0])
    tree, ends = SearchTree.balanced([whole[k][0] for k in keys], [whole[k][1] for k in keys])
    end_of = dict(zip(keys, ends, strict=True))
    totals = Totals(tree)
    for key, own in paths.items():
        nodes = tree.path(end_of[key])
        for row in own:
            node = nodes[row[2]]
            totals.add(node, row[6], row[3], row[10])
            totals.children[node] += row[7]
            totals.leaves[node] += row[8]
            totals.saved[node] += row[9]
    totals.roll_up()

    def out() -> Iterator[tuple]:
        for node in range(len(tree.key)):
            yield (None, None, tree.depth[node], totals.first[node], None, totals.first[tree.parent[node]] if node else None, totals.members[node],
                   totals.children[node], totals.leaves[node], totals.saved[node], totals.ends[node], None, None)
        for (shard, side), own in paths.items():
            nodes = tree.path(end_of[shard, side])
            for row in own:
                yield (shard, side, row[2], totals.first[nodes[row[2]]], *[None] * 9)

    if rows:
        yield from _in_blocks(out())


def trie_of(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """All nodes of the trie over distinct ``seq, sizes, conv_id, n, ends``."""
    stored = keep(sequences, "trie-sequences")
    turns = stored.agg(F.sum(F.size("seq") + 1)).first()[0] or 0
    shards = max(1, -(-turns // shard_turns))
    sharded = stored.repartitionByRange(shards, "seq").sortWithinPartitions("seq")
    nodes = keep(sharded.mapInArrow(_shards, _NODES), "trie-nodes")
    boundary = nodes.where("path is not null").repartition(1)
    merged = keep(boundary.mapInArrow(_merged, _NODES), "trie-boundary")
    settled = nodes.where("path is null").select("shard", "up", *_OUT, (F.col("depth") - 1).alias("_up_depth"))
    names = merged.where("path is not null").select(
        F.col("shard").alias("_shard"), F.col("path").alias("_path"), F.col("depth").alias("_depth"), F.col("conv_id").alias("_first")
    )
    of_parent = (F.col("shard") == F.col("_shard")) & (F.col("up") == F.col("_path")) & (F.col("_up_depth") == F.col("_depth"))
    below = settled.where("up is not null").join(names, of_parent).withColumn("parent_conv_id", F.col("_first"))
    every = settled.where("up is null").select(*_OUT).unionByName(below.select(*_OUT)).unionByName(merged.where("path is null").select(*_OUT))
    return every.withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS))).withColumnRenamed("ends", "ends_sha256")


_OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")


def prefix_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS, pack: int = PACK_IDS) -> DataFrame:
    """Nodes of the prefix trie over the rebuilt conversations of ``conv_id, turn, role, text``."""
    own = keep(conversations(turns), "trie-conversations")
    return trie_of(distinct_sequences(keep(rebuilt(own), "trie-rebuilt"), pack), shard_turns)
