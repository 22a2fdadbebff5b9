"""Best-fit-decreasing packing into binary id rows.

A task gathers documents up to ``group_tokens`` ids and splits documents longer than a sequence into full pieces and
a tail, losing no id. Pieces go by descending length into the open sequence with the least room that still fits
them; a segment tree over room sizes finds it. Each sequence becomes one row: its ids padded to the full length and
written as little-endian integers, the cumulative segment lengths, and positions that restart at every segment.

No shuffle; memory is one group. Null or empty text: the end id alone. Null ids stay null in ``doc_ids``. Repeated
rows are packed as often as they occur; ties keep reading order. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import map_rows, require
from casegrid.llm.tokens import default_vocabulary, encoded

ROWS = "sequence_id long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, n_tokens int, ids binary, position_ids binary"


class RoomTree:
    """How many sequences have each room size; the least size of at least n in logarithmic time."""

    def __init__(self, limit: int):
        self.leaves = 1 << limit.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, change: int) -> None:
        i = self.leaves + room
        while i:
            self.count[i] += change
            i >>= 1

    def least(self, n: int) -> int | None:
        i = self.leaves + n
        if self.count[i]:
            return n
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit(lengths: list[int], limit: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length)."""
    pieces = []
    for doc, n in enumerate(lengths):
        pieces += [(min(limit, n - at), doc, at) for at in range(0, n, limit)]
    pieces.sort(key=lambda p: -p[0])
    tree = RoomTree(limit)
    with_room: list[list[int]] = [[] for _ in range(limit + 1)]
    sequences: list[list[tuple[int, int, int]]] = []
    for n, doc, at in pieces:
        room = tree.least(n)
        if room is None:
            room = limit
            sequences.append([])
            s = len(sequences) - 1
        else:
            s = with_room[room].pop()
            tree.add(room, -1)
        sequences[s].append((doc, at, n))
        if room > n:
            with_room[room - n].append(s)
            tree.add(room - n, 1)
    return sequences


def pack_binary(
    docs: DataFrame,
    vocabulary: str | None = None,
    sequence_length: int = 2048,
    end_id: int = 1,
    pad_id: int = 0,
    id_type: str = "<u2",
    group_tokens: int = 2_000_000,
) -> DataFrame:
    """One row per sequence. ``id_type`` is the little-endian type of ids; it must hold every id of the vocabulary."""
    require(docs, "doc_id", "text")
    path = vocabulary or default_vocabulary()
    most = np.iinfo(id_type).max

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        next_id = TaskContext.get().partitionId() << 32

        def packed(keys: list, ids: list[np.ndarray], first: int) -> dict[str, list]:
            out: dict[str, list] = {f.split()[0]: [] for f in ROWS.split(", ")}
            for s, parts in enumerate(best_fit([len(x) for x in ids], sequence_length)):
                matrix = np.full(sequence_length, pad_id, dtype=id_type)
                positions = np.zeros(sequence_length, dtype="<u2" if sequence_length <= 65536 else "<u4")
                ends = [0]
                for doc, at, n in parts:
                    part = ids[doc][at : at + n]
                    if part.max() > most:
                        raise ValueError(f"id {part.max()} does not fit {id_type}")
                    matrix[ends[-1] : ends[-1] + n] = part
                    positions[ends[-1] : ends[-1] + n] = np.arange(n)
                    ends.append(ends[-1] + n)
                out["sequence_id"].append(first + s)
                out["doc_ids"].append([keys[doc] for doc, _, _ in parts])
                out["starts"].append([at for _, at, _ in parts])
                out["cu_seqlens"].append(ends)
                out["n_tokens"].append(ends[-1])
                out["ids"].append(matrix.tobytes())
                out["position_ids"].append(positions.tobytes())
            return out

        keys: list = []
        ids: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                keys.append(key)
                ids.append(encoded(text, path, end_id))
                held += len(ids[-1])
                if held >= group_tokens:
                    made = packed(keys, ids, next_id)
                    next_id += len(made["ids"])
                    yield made
                    keys, ids, held = [], [], 0
        if keys:
            yield packed(keys, ids, next_id)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(narrow, ROWS, rows)
