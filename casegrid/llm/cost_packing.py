"""Cost-balanced packing of documents into fixed-length sequences.

Every document becomes its token ids and an end id. A task gathers documents up to ``group_tokens`` ids, opens
sequences whose capacities add up to exactly the ids gathered (full ones, and one for each binary digit of what is
left over, as lengths at a power of two need no padding), and hands out pieces by descending length: each goes to
the sequence of least estimated cost that still has room for it. The cost of a piece of n ids is
``linear * n + quadratic * n * n``. A piece that fits nowhere whole is cut at the largest room left.

No shuffle: a task packs the rows it reads, so memory is one group. A lost task reads the same rows of the stored
table again and packs them alike. The rows should come from a stored table, not from a shuffle with open order.

Null or empty text: the end id alone. Null ids stay null. Repeated rows are packed as often as they occur.
Ties in cost go to the sequence opened first, ties in length to the row read first. An empty table gives no rows;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import map_rows, require
from casegrid.llm.tokens import default_vocabulary, encoded

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_cost double"


@dataclass
class Piece:
    doc: int
    start: int
    length: int
    sequence: int
    offset: int


def capacities(total: int, limit: int) -> list[int]:
    """Sequence lengths that add up to ``total``: as many full ones as fit, then the powers of two of the rest."""
    rest = total % limit
    return [limit] * (total // limit) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def balanced(lengths: list[int], limit: int, linear: float, quadratic: float) -> tuple[list[Piece], list[float]]:
    """Pieces of documents of these lengths and the cost of each sequence."""
    room = capacities(sum(lengths), limit)
    size = list(room)
    cost = [0.0] * len(room)
    waiting: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]
    for doc, n in enumerate(lengths):
        full, tail = divmod(n, limit)
        waiting[limit].extend((doc, i * limit) for i in range(full))
        if tail:
            waiting[tail].append((doc, full * limit))
    parked: list[list[int]] = [[] for _ in range(limit + 1)]
    for s, r in enumerate(room):
        parked[r].append(s)
    open_: list[tuple[float, int]] = []  # sequences with room for the length at hand
    pieces = []

    def put(s: int, doc: int, start: int, n: int) -> None:
        pieces.append(Piece(doc, start, n, s, size[s] - room[s]))
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n

    for n in range(limit, 0, -1):
        for s in parked[n]:
            heapq.heappush(open_, (cost[s], s))
        parked[n] = []
        below = n - 1
        for doc, start in waiting[n]:
            if open_:
                s = heapq.heappop(open_)[1]
                put(s, doc, start, n)
                if room[s] >= n:
                    heapq.heappush(open_, (cost[s], s))
                elif room[s]:
                    parked[room[s]].append(s)
                    below = max(below, room[s])
                continue
            while not parked[below]:
                below -= 1
            s = min(parked[below], key=lambda x: (cost[x], x))
            parked[below].remove(s)
            put(s, doc, start, below)
            waiting[n - below].append((doc, start + below))
    return pieces, cost


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    sequence_length: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1.0 / 4096,
    group_tokens: int = 4_000_000,
) -> DataFrame:
    """One row per piece: its document, place there, ids (little-endian 32-bit), sequence and offset in it."""
    require(docs, "doc_id", "text")
    path = vocabulary or default_vocabulary()

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        base = TaskContext.get().partitionId() << 32
        next_sequence = 0
        keys: list = []
        ids: list[np.ndarray] = []
        held = 0

        def packed() -> tuple[dict[str, list], int]:
            pieces, cost = balanced([len(x) for x in ids], sequence_length, linear, quadratic)
            return {
                "doc_id": [keys[p.doc] for p in pieces],
                "start": [p.start for p in pieces],
                "length": [p.length for p in pieces],
                "ids": [ids[p.doc][p.start : p.start + p.length].astype("<u4").tobytes() for p in pieces],
                "doc_tokens": [len(ids[p.doc]) for p in pieces],
                "sequence_id": [base + next_sequence + p.sequence for p in pieces],
                "offset": [p.offset for p in pieces],
                "sequence_cost": [cost[p.sequence] for p in pieces],
            }, len(cost)

        for batch in batches:
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                keys.append(key)
                ids.append(encoded(text, path, end_id))
                held += len(ids[-1])
                if held >= group_tokens:
                    made, n = packed()
                    yield made
                    next_sequence += n
                    keys, ids, held = [], [], 0
        if keys:
            yield packed()[0]

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(narrow, PIECES, rows)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids; computed where the rows are."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


__all__ = ["balanced", "capacities", "pack", "piece_digests"]
