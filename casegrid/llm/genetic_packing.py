"""Packing into few sequences by a grouping genetic algorithm on islands.

Documents become token ids and an end id; longer ones are cut into full pieces, the first of which takes what is left
over. Full pieces are sequences by themselves. The others are dealt by hash to islands of some ``island_items`` pieces,
of which only lengths travel. Every island keeps a population of packings. A crossover injects whole well-filled bins of
one parent into the other, drops the bins that now hold a document twice, and best-fits the documents so displaced, in
descending order; a mutation dissolves the emptiest bins and a few others in the same way. After every epoch the lengths
in each island's best-filled bins migrate to the next island, which fills such bins with documents of its own and
injects them. An island that has reached the least possible number of bins rests.

At the end the bins under ``settled`` of a sequence are dissolved and their pieces dealt to fewer islands, again and
again until there is one, so that not every island leaves a bin half empty.

An epoch is a table in the shared folder: a lost executor costs its islands one epoch. An island is one row of bounded
size; token ids are written once, with their pieces, and join the places found by a narrow key.

Null or empty text: the end id alone. Null ids stay null. Repeated rows are packed as often as they occur. Ties: equal
lengths go in order of the piece key, equally good packings are kept in the order found. An empty table gives no rows;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import map_rows, require, small_batches
from casegrid.llm.tokens import default_vocabulary, encoded
from casegrid.session import cut_lineage

PIECES = "piece_key long, doc_id long, piece int, start long, length long, ids binary, ids_crc32 long"
STATE = "island long, lengths array<int>, population array<array<int>>, emigrants array<array<int>>, open_bins int"
PLACES = "piece_key long, sequence_id long, offset long, fill int"
Bin = tuple[int, ...]
Packing = list[Bin]


# --- one island


def _fill(packing_bin: Bin, lengths: Sequence[int]) -> int:
    return sum(lengths[i] for i in packing_bin)


def best_fit(packing: Packing, items: list[int], lengths: Sequence[int], limit: int) -> Packing:
    """``packing`` with ``items`` added in the order given, each to the bin with the least room that holds it.

    The rooms that occur are bits of one number, so the least room from n on is its lowest bit beyond n.
    """
    bins = [list(b) for b in packing]
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms = 0
    for k, b in enumerate(packing):
        room = limit - _fill(b, lengths)
        by_room[room].append(k)
        rooms |= 1 << room
    rooms &= ~1
    for i in items:
        n = lengths[i]
        beyond = rooms >> n
        if beyond:
            room = n + (beyond & -beyond).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[k].append(i)
        else:
            room, k = limit, len(bins)
            bins.append([i])
        if room > n:
            by_room[room - n].append(k)
            rooms |= 1 << (room - n)
    return [tuple(b) for b in bins]


def inject(packing: Packing, donors: Packing, lengths: Sequence[int], limit: int) -> Packing:
    """The packing with the donor bins in it: bins that hold one of their items go, and what else was in them is best-fitted."""
    given = {i for b in donors for i in b}
    kept, displaced = [], []
    for b in packing:
        if given.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in given]
    return best_fit(kept + donors, sorted(displaced), lengths, limit)


def rank(packing: Packing, lengths: Sequence[int]) -> tuple[int, int]:
    """Fewer bins first, then the fuller ones fuller: less is better."""
    return len(packing), -sum(_fill(b, lengths) ** 2 for b in packing)


def least_bins(lengths: Sequence[int], limit: int) -> int:
    """No packing has fewer bins: by the sum, and as pieces over half a bin never share one."""
    return max(math.ceil(sum(lengths) / limit), sum(2 * n > limit for n in lengths))


class Island:
    """A population of packings of items 0..n-1, whose ``lengths`` do not rise."""

    def __init__(self, lengths: Sequence[int], limit: int, chance: random.Random, population: list[Packing] | None = None, size: int = 6):
        self.lengths, self.limit, self.chance = lengths, limit, chance
        self.bound = least_bins(lengths, limit)
        start = population or [best_fit([], list(range(len(lengths))), lengths, limit)]
        self.people = sorted(((rank(p, lengths), k, p) for k, p in enumerate(start)), key=lambda x: x[:2])
        self.born, self.size = len(start), size
        for _ in range(0 if population else size - 1):
            if not self.done:
                order = sorted(range(len(lengths)), key=lambda i: -lengths[i] * (1 + 0.3 * chance.random()))
                self._admit(best_fit([], order, lengths, limit))

    @property
    def best(self) -> Packing:
        return self.people[0][2]

    @property
    def done(self) -> bool:
        return len(self.best) <= self.bound

    def _admit(self, packing: Packing) -> None:
        worth = rank(packing, self.lengths)
        if any(worth == other for other, _, _ in self.people):  # one of a kind is enough
            return
        self.people.append((worth, self.born, packing))
        self.born += 1
        self.people.sort(key=lambda x: x[:2])
        del self.people[self.size :]

    def _parent(self) -> Packing:
        """The better of two drawn ones."""
        return self.people[min(self.chance.randrange(len(self.people)) for _ in range(2))][2]

    def _well_filled(self, packing: Packing, share: float) -> Packing:
        """A random part of the fuller half of the bins."""
        fuller = sorted(packing, key=lambda b: -_fill(b, self.lengths))[: max(1, len(packing) // 2)]
        return self.chance.sample(fuller, max(1, int(share * len(fuller))))

    def _mutated(self, packing: Packing) -> Packing:
        order = sorted(range(len(packing)), key=lambda k: _fill(packing[k], self.lengths))
        gone = set(order[: 1 + len(order) // 50]) | set(self.chance.sample(order, min(len(order), 2 + len(order) // 50)))
        loose = sorted(i for k in gone for i in packing[k])
        if self.chance.random() < 0.5:  # now and then in another order, or all refits end alike
            self.chance.shuffle(loose)
        return best_fit([b for k, b in enumerate(packing) if k not in gone], loose, self.lengths, self.limit)

    def evolve(self, generations: int, share: float = 0.2) -> None:
        for _ in range(generations):
            if self.done or not self.lengths:
                return
            child = inject(self._parent(), self._well_filled(self._parent(), share), self.lengths, self.limit)
            self._admit(child)
            self._admit(self._mutated(child))

    def emigrants(self, most: int) -> list[list[int]]:
        """Lengths in the best packing's fullest bins of several items."""
        shared = [b for b in self.best if len(b) > 1]
        shared.sort(key=lambda b: (-_fill(b, self.lengths), b))
        return [[self.lengths[i] for i in b] for b in shared[:most]]

    def settle(self, patterns: list[list[int]]) -> None:
        """Bins of these lengths, as far as there are items for them, go into the best packing."""
        free: dict[int, list[int]] = defaultdict(list)
        for i in reversed(range(len(self.lengths))):
            free[self.lengths[i]].append(i)
        donors: Packing = []
        for pattern in patterns:
            need: dict[int, int] = defaultdict(int)
            for n in pattern:
                need[n] += 1
            if all(len(free[n]) >= k for n, k in need.items()):
                donors.append(tuple(free[n].pop() for n in pattern))
        if donors and not self.done:
            self._admit(inject(self.best, donors, self.lengths, self.limit))


# --- packings as columns: the bin of every item


def _bin_numbers(packing: Packing, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(packing):
        for i in b:
            out[i] = k
    return out


def _packing(numbers: list[int]) -> Packing:
    bins: dict[int, list[int]] = defaultdict(list)
    for i, k in enumerate(numbers):
        bins[k].append(i)
    return [tuple(bins[k]) for k in sorted(bins)]


# --- Spark jobs


def token_pieces(docs: DataFrame, vocabulary: str | None = None, sequence_length: int = 2048, end_id: int = 0, id_type: str = "<u2") -> DataFrame:
    """One row per piece: a key, its document and place there, its ids as ``id_type`` and their CRC-32 as 32-bit ids."""
    require(docs, "doc_id", "text")
    path = vocabulary or default_vocabulary()
    most = np.iinfo(id_type).max

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: dict[str, list] = {f.split()[0]: [] for f in PIECES.split(", ")}
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encoded(text, path, end_id)
                if ids.max() > most:
                    raise ValueError(f"id {ids.max()} does not fit {id_type}")
                ends = range(len(ids) % sequence_length or sequence_length, len(ids) + 1, sequence_length)
                start = 0
                for piece, end in enumerate(ends):
                    part = ids[start:end]
                    for name, value in (
                        ("piece_key", key), ("doc_id", doc), ("piece", piece), ("start", start), ("length", end - start),
                        ("ids", part.astype(id_type).tobytes()), ("ids_crc32", zlib.crc32(part.astype("<u4").tobytes())),
                    ):
                        out[name].append(value)
                    key += 1
                    start = end
            yield out

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(narrow, PIECES, rows)


def _islands(items: DataFrame, islands: int, seed: int) -> DataFrame:
    """One row per island: the keys and lengths of its items, the longest first."""
    placed = items.withColumn("island", F.pmod(F.xxhash64(F.lit(seed), "piece_key"), F.lit(islands)))
    listed = placed.groupBy("island").agg(F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("less"), "piece_key"))).alias("items"))
    lengths = F.transform("items", lambda x: (-x["less"]).cast("int"))
    return cut_lineage(listed.select("island", F.col("items.piece_key").alias("keys"), lengths.alias("lengths")))


def _spread(df: DataFrame, islands: int) -> DataFrame:
    """Islands are small rows of long work: as many tasks as there are islands, up to some thousands."""
    return small_batches(df.repartitionByRange(min(islands, 8192), "island"))


def _epoch(state: DataFrame, islands: int, limit: int, seed: int, generations: int, migrants: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = row["lengths"]
                old = [_packing(numbers) for numbers in row["population"] or []]
                island = Island(lengths, limit, random.Random(f"{seed}-{row['island']}"), old)
                island.settle(row["immigrants"] or [])
                island.evolve(generations)
                out = {
                    "island": row["island"], "lengths": lengths, "population": [_bin_numbers(p, len(lengths)) for _, _, p in island.people],
                    "emigrants": island.emigrants(migrants), "open_bins": len(island.best) - island.bound,
                }
                yield pa.RecordBatch.from_pylist([out], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(STATE))
    return cut_lineage(_spread(state, islands).mapInArrow(run, STATE))


def _places(members: DataFrame, state: DataFrame, limit: int, level: int) -> DataFrame:
    """The place of every item in the best packing of its island."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, keys = row["lengths"], row["keys"]
                out: dict[str, list] = {"piece_key": [], "sequence_id": [], "offset": [], "fill": []}
                for k, b in enumerate(_packing(row["best"])):
                    at, fill = 0, _fill(b, lengths)
                    for i in b:
                        for name, value in (("piece_key", keys[i]), ("sequence_id", level << 56 | row["island"] << 24 | k), ("offset", at), ("fill", fill)):
                            out[name].append(value)
                        at += lengths[i]
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(PLACES))
    best = state.select("island", F.col("population")[0].alias("best"))
    return cut_lineage(small_batches(members.join(best, "island")).mapInArrow(run, PLACES))


def pack_items(
    items: DataFrame, limit: int = 2048, island_items: int = 8192, epochs: int = 3, generations: int = 12, migrants: int = 64, settled: float = 0.97, seed: int = 11
) -> DataFrame:
    """(piece_key, sequence_id, offset) of ``items`` (piece_key, length), all shorter than ``limit``."""
    done: list[DataFrame] = []
    level = 0
    count = items.count()
    while count:
        islands = math.ceil(count / island_items)
        members = _islands(items, islands, seed + level)
        state = members.select("island", "lengths", F.lit(None).cast("array<array<int>>").alias("population"))
        state = state.withColumn("immigrants", F.lit(None).cast("array<array<int>>"))
        for epoch in range(epochs):
            state = _epoch(state, islands, limit, seed * 1000 + level * 100 + epoch, generations, migrants)
            if epoch + 1 == epochs or state.filter("open_bins > 0").isEmpty():
                break
            arriving = state.select(F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("emigrants").alias("immigrants"))
            state = state.select("island", "lengths", "population").join(arriving, "island", "left")
        places = _places(members, state, limit, level)
        loose = F.col("fill") < int(settled * limit)
        left = places.filter(loose).count() if islands > 1 else 0
        if not left or left > count // 2:  # bins that cannot be filled well are not worth another deal
            done.append(places)
            break
        done.append(places.filter(~loose))
        items = cut_lineage(items.join(places.filter(loose).select("piece_key"), "piece_key", "left_semi"))
        count, level = left, level + 1
    if not done:
        return items.sparkSession.createDataFrame([], "piece_key long, sequence_id long, offset long")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("piece_key", "sequence_id", "offset")


def pack(docs: DataFrame, vocabulary: str | None = None, sequence_length: int = 2048, end_id: int = 0, **how) -> DataFrame:
    """One row per piece of :func:`token_pieces` with its ``sequence_id`` and ``offset``; ``how`` goes to :func:`pack_items`."""
    pieces = cut_lineage(token_pieces(docs, vocabulary, sequence_length, end_id))
    short = F.col("length") < sequence_length
    whole = pieces.filter(~short).select("*", (-1 - F.col("piece_key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    places = pack_items(pieces.filter(short).select("piece_key", "length"), sequence_length, **how)
    return whole.unionByName(pieces.filter(short).join(places, "piece_key"))


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


__all__ = ["Island", "best_fit", "inject", "least_bins", "pack", "pack_items", "piece_digests", "token_pieces"]
