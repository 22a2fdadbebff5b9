"""Prefix trie of conversations, shard by shard, over dictionary-encoded turns.

Every distinct (role, text) gets a number from a dictionary table. The conversations, as lists of these numbers, are
dealt out by ranges in order of (list, conv_id), so a shard holds neighbours and copies of one conversation spread over
as many shards as they need. Inside a shard, blocks of bounded size go into a ternary search tree: a block's distinct
lists are inserted median first, then the medians of both halves, which keeps every level balanced. An iterative
traversal adds up members, leaves and savings.

A node is closed when no list outside the block can start with it, which holds for all but the prefixes of the first
and the last list of the block. Closed nodes are results. The open ones go on as boundary paths: a list with, per depth,
what the block knows of it. Paths are themselves sorted and put into trees, which closes the nodes inside again, until one
block holds them all. There are two paths a block, so the last block is small. Ids of members that end at an open node
travel beside, joined into one text per block, and are hashed in order of their first id, by a task that reads a text at
a time. A closed node under an open one learns its parent's least member by a join at the end.

A list is one row, so a task needs room for the longest conversation: 12 bytes a turn, or some 100 in the tree. Each step
is a table in the shared folder; a lost executor costs the tasks of one step.

Null turns come first, null roles and texts are empty. Rows that share a turn number come in order of a digest of role
and text; repeated rows are turns of their own. Rows without conv_id belong to no conversation and are left out. An empty
table has no root and gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import require, small_batches
from casegrid.session import cut_lineage

#: Turns of a block, unless a single list is longer.
BLOCK_TURNS = 200_000
#: Turns of boundary paths that one task may put into its last block.
LAST_TURNS = 1_000_000
EMPTY = hashlib.sha256(b"").hexdigest()
NODES = (
    "kind string, conv_id long, depth long, parent_conv_id long, parent_key binary, key binary, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, first_end long, ends string, ids array<long>, lens array<int>, "
    "least array<long>, convs array<long>, kids array<long>, leaves array<long>, saved array<long>"
)
RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


# --- conversations as lists of turn numbers


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, lens): numbers and code points of the turns of each conversation, in order."""
    require(conversations, "conv_id", "turn", "role", "text")
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.length(text).cast("int").alias("len"),
    )
    dictionary = rows.groupBy("digest").agg(F.max("len").alias("len"))
    dictionary = cut_lineage(dictionary.select("digest", "len", F.monotonically_increasing_id().alias("id")))
    turns = rows.select("conv_id", "turn", "digest").join(dictionary, "digest")
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "id", "len"))).alias("turns"))
    return ordered.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.len").alias("lens"))


def crossed(lists: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """Each list with its first h turns replaced by those of the family's first conversation; h = crc32(conv_id) % ``most``."""
    lists = cut_lineage(lists)
    base = F.col("conv_id") - F.col("conv_id") % family
    heads = lists.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.slice("ids", 1, most - 1).alias("head_ids"), F.slice("lens", 1, most - 1).alias("head_lens")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")

    def joined(head: str, own: str, kind: str) -> Column:
        start = F.coalesce(F.slice(head, 1, F.col("h")), F.array().cast(f"array<{kind}>"))
        return F.concat(start, F.slice(own, F.col("h") + 1, F.greatest(F.size(own) - F.col("h"), F.lit(0)))).alias(own)

    both = lists.withColumn("base", base).withColumn("h", h).join(heads, "base", "left")
    return both.select("conv_id", joined("head_ids", "ids", "long"), joined("head_lens", "lens", "int"))


# --- the tree of one block


@dataclass
class Path:
    """A list and what is known of its nodes, by depth: least member, members, closed children, their leaves and savings."""

    ids: list[int]
    lens: list[int]
    least: list[int]
    convs: list[int]
    kids: list[int]
    leaves: list[int]
    saved: list[int]
    ends: list[int] = field(default_factory=list)


class TernaryTree:
    """Nodes hold a turn number; ``low`` and ``high`` lead to smaller and larger ones, ``below`` to the next turn."""

    def __init__(self, root: Path):
        self.turn, self.low, self.high, self.below = [-1], [0], [0], [0]
        self.len, self.depth = [0], [0]
        self.least, self.convs, self.kids, self.leaves, self.saved = [root.least[0]], [0], [0], [0], [0]
        self.ends: dict[int, list[int]] = {}

    def _new(self, turn: int, length: int, depth: int, least: int) -> int:
        for column, value in (
            (self.turn, turn), (self.low, 0), (self.high, 0), (self.below, 0), (self.len, length), (self.depth, depth),
            (self.least, least), (self.convs, 0), (self.kids, 0), (self.leaves, 0), (self.saved, 0),
        ):
            column.append(value)
        return len(self.turn) - 1

    def _add(self, node: int, path: Path, depth: int) -> None:
        if path.least[depth] < self.least[node]:
            self.least[node] = path.least[depth]
        self.convs[node] += path.convs[depth]
        self.kids[node] += path.kids[depth]
        self.leaves[node] += path.leaves[depth]
        self.saved[node] += path.saved[depth]

    def insert(self, path: Path) -> None:
        turn, low, high, below = self.turn, self.low, self.high, self.below
        self._add(0, path, 0)
        node = 0
        for depth, wanted in enumerate(path.ids, 1):
            at = below[node]
            if not at:
                at = below[node] = self._new(wanted, path.lens[depth - 1], depth, path.least[depth])
            while turn[at] != wanted:
                side = low if wanted < turn[at] else high
                if not side[at]:
                    side[at] = self._new(wanted, path.lens[depth - 1], depth, path.least[depth])
                at = side[at]
            self._add(at, path, depth)
            node = at
        if path.ends:
            self.ends.setdefault(node, []).extend(path.ends)

    def ordered(self) -> list[tuple[int, int]]:
        """(node, parent) of every node, parents first, children by turn number."""
        out, stack = [], [(0, -1, True)]
        while stack:
            at, parent, whole = stack.pop()
            if not whole:
                out.append((at, parent))
                if self.below[at]:
                    stack.append((self.below[at], at, True))
                continue
            if self.high[at]:
                stack.append((self.high[at], parent, True))
            stack.append((at, parent, False))
            if self.low[at]:
                stack.append((self.low[at], parent, True))
        return out


def balanced_order(n: int) -> Iterator[int]:
    """Positions 0..n-1: the median, then the medians of both halves, and so on."""
    spans = [(0, n)]
    while spans:
        a, b = spans.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            spans += [(middle + 1, b), (a, middle)]


def prefix_keys(ids: list[int]) -> list[bytes]:
    """A key for every prefix of a list, the empty one first."""
    state = hashlib.blake2b(digest_size=16)
    keys = [state.digest()]
    for number in np.asarray(ids, dtype="<i8"):
        state.update(number.tobytes())
        keys.append(state.digest())
    return keys


def _ends_text(ends: list[int]) -> str:
    return ",".join(map(str, sorted(ends)))


def along(tree: TernaryTree, ids: list[int]) -> list[int]:
    """The nodes of a list that is in the tree, the root first."""
    node, out = 0, [0]
    for wanted in ids:
        node = tree.below[node]
        while tree.turn[node] != wanted:
            node = tree.low[node] if wanted < tree.turn[node] else tree.high[node]
        out.append(node)
    return out


def block_rows(paths: list[Path], last: bool, with_keys: bool) -> Iterator[dict]:
    """Closed nodes, ends of open ones, and the block's boundary paths; all nodes are closed in the ``last`` block.

    ``paths`` are distinct and sorted by their ids. ``with_keys``: rows of nodes have their keys too.
    """
    tree = TernaryTree(paths[0])
    for i in balanced_order(len(paths)):
        tree.insert(paths[i])
    order = tree.ordered()
    kids, leaves, saved = tree.kids, tree.leaves, tree.saved
    edges = [] if last else paths[:1] if len(paths) == 1 else [paths[0], paths[-1]]
    edge_nodes = [along(tree, path.ids) for path in edges]
    edge_keys = [prefix_keys(path.ids) for path in edges]
    open_at: dict[int, tuple[int, int]] = {}  # node: which of the edges has its numbers, depth
    for side, nodes in enumerate(edge_nodes):
        for depth, node in enumerate(nodes):
            open_at.setdefault(node, (side, depth))
    for node, parent in reversed(order):  # children before parents
        if node in open_at:
            continue
        if not kids[node]:
            leaves[node] += 1
        saved[node] += (tree.convs[node] - 1) * tree.len[node]
        if parent >= 0:
            kids[parent] += 1
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
    states = {}
    for node, parent in order:
        if with_keys:
            states[node] = states[parent].copy() if parent >= 0 else hashlib.blake2b(digest_size=16)
            if parent >= 0:
                states[node].update(tree.turn[node].to_bytes(8, "little"))
        if node in open_at:
            if node in tree.ends:
                side, depth = open_at[node]
                yield {"kind": "ends", "key": edge_keys[side][depth], "first_end": min(tree.ends[node]), "ends": _ends_text(tree.ends[node])}
            continue
        row = {"kind": "closed", "conv_id": tree.least[node], "depth": tree.depth[node], "n_convs": tree.convs[node]}
        row |= {"n_children": kids[node], "n_leaves": leaves[node], "saved_tokens": saved[node]}
        if with_keys:
            row["key"] = states[node].digest()
        if node in tree.ends:
            row["ends_sha256"] = hashlib.sha256(_ends_text(tree.ends[node]).encode()).hexdigest()
        if parent in open_at:
            side, depth = open_at[parent]
            row |= {"kind": "rim", "parent_key": edge_keys[side][depth]}
        elif parent >= 0:
            row["parent_conv_id"] = tree.least[parent]
        yield row
    for side, (path, nodes) in enumerate(zip(edges, edge_nodes, strict=True)):
        own = [open_at[node][0] == side for node in nodes]  # what both paths share counts once

        def numbers(column: list[int], nodes: list[int] = nodes, own: list[bool] = own) -> list[int]:
            return [column[node] if mine else 0 for node, mine in zip(nodes, own, strict=True)]

        yield {
            "kind": "path", "ids": path.ids, "lens": path.lens, "least": [tree.least[node] for node in nodes], "convs": numbers(tree.convs),
            "kids": numbers(kids), "leaves": numbers(leaves), "saved": numbers(saved),
        }


def blocks(paths: Iterable[Path], most_turns: int) -> Iterator[list[Path]]:
    """Sorted runs of distinct lists of some ``most_turns`` turns, with equal lists made one."""
    block: list[Path] = []
    held = 0
    for path in paths:
        if block and (held >= most_turns or path.ids < block[-1].ids):
            yield block
            block, held = [], 0
        if block and path.ids == block[-1].ids:
            _join(block[-1], path)
            held += 1
        else:
            block.append(path)
            held += len(path.ids) + 1
    if block:
        yield block


def _join(into: Path, more: Path) -> None:
    for name in ("convs", "kids", "leaves", "saved"):
        own, other = getattr(into, name), getattr(more, name)
        for i, value in enumerate(other):
            own[i] += value
    for i, value in enumerate(more.least):
        if value < into.least[i]:
            into.least[i] = value
    into.ends += more.ends


def _shard_job(from_lists: bool, most_turns: int, last: bool):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(NODES))

    def paths(batches: Iterable[pa.RecordBatch]) -> Iterator[Path]:
        for batch in batches:
            for row in batch.to_pylist():
                if from_lists:
                    n = len(row["ids"]) + 1
                    yield Path(row["ids"], row["lens"], [row["conv_id"]] * n, [1] * n, [0] * n, [0] * n, [0] * n, [row["conv_id"]])
                else:
                    yield Path(*(row[name] for name in ("ids", "lens", "least", "convs", "kids", "leaves", "saved")))

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], type=f.type) for f in arrow], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for block in blocks(paths(batches), most_turns):
            for row in block_rows(block, last, not from_lists):
                held.append(row)
                if len(held) >= 5000:
                    yield batch_of(held)
                    held = []
        if held:
            yield batch_of(held)

    return run


# --- from shards to one tree


def _ends_hashes(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): the joined texts of a key in order of their first id, read one at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != key:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = own, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.binary(), pa.string()))], names=["key", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    sorted_texts = ends.select("key", "ends", "first_end").repartition("key").sortWithinPartitions("key", "first_end")
    return small_batches(sorted_texts.select("key", "ends")).mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(lists: DataFrame, block_turns: int = BLOCK_TURNS, last_turns: int = LAST_TURNS) -> DataFrame:
    """One row per node of the trie of ``lists`` (conv_id, ids, lens); conv_id is unique."""
    lists = cut_lineage(lists.select("conv_id", "ids", "lens"))
    sharded = lists.repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    steps = [cut_lineage(small_batches(sharded).mapInArrow(_shard_job(True, block_turns, False), NODES))]
    turns = None
    while True:
        paths = steps[-1].filter("kind = 'path'")
        before, turns = turns, paths.agg(F.sum(F.size("ids") + 1)).first()[0]
        if turns is None:  # no conversation at all
            break
        if before is not None and turns > before // 2:  # long lists: give a task more room rather than go on for ever
            last_turns *= 2
        if turns <= last_turns:
            one = paths.coalesce(1).sortWithinPartitions("ids")
            steps.append(cut_lineage(small_batches(one).mapInArrow(_shard_job(False, turns + 1, True), NODES)))
            break
        shards = max(2, int(4 * turns // last_turns))
        sharded = paths.repartitionByRange(shards, "ids").sortWithinPartitions("ids")
        steps.append(cut_lineage(small_batches(sharded).mapInArrow(_shard_job(False, last_turns, False), NODES)))
    return _finished(steps) if len(steps) > 1 else lists.sparkSession.createDataFrame([], RESULT)


def _finished(steps: list[DataFrame]) -> DataFrame:
    """Closed nodes as they are; those that were open once with their ends hashed; parents of rim nodes by their keys."""
    first, later = steps[0], steps[1]
    for step in steps[2:]:
        later = later.unionByName(step)
    hashes = _ends_hashes(first.filter("kind = 'ends'"))
    later = cut_lineage(later.filter("kind in ('closed', 'rim')").drop("ends_sha256").join(hashes, "key", "left"))
    root = later.filter("depth = 0").select("conv_id").first()[0]
    # children of the root, most of all rim nodes, know their parent without a join
    parents = later.filter("depth > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    columns = [f.split()[0] for f in RESULT.split(", ")]

    def done(df: DataFrame, parent: Column) -> DataFrame:
        return df.withColumn("parent_conv_id", parent).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))).select(*columns)

    wanted = [f.split()[0] for f in RESULT.split(", ")] + ["kind", "parent_key"]
    both = first.select(*wanted).unionByName(later.select(*wanted))
    closed = done(both.filter("kind = 'closed'"), F.col("parent_conv_id"))
    top = done(both.filter("kind = 'rim' and depth = 1"), F.lit(root).cast("long"))
    rim = done(both.filter("kind = 'rim' and depth > 1").join(parents, "parent_key"), F.col("parent"))
    return closed.unionByName(top).unionByName(rim)


__all__ = ["TernaryTree", "balanced_order", "block_rows", "crossed", "prefix_trie", "turn_lists"]
