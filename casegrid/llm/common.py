"""Helpers shared by the text operators: batches, words, hashes and row checks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries a worker keeps in its word table before it starts anew.
WORD_TABLE_SIZE = 200_000
#: Longer words are hashed anew each time, so that the table is bounded in bytes too.
WORD_BYTES = 64
#: Bytes of a batch that a worker holds at a time, whatever the length of the texts.
BATCH_BYTES = "4m"

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def small_batches(df: DataFrame) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def map_rows(df: DataFrame, schema: str, rows: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]]) -> DataFrame:
    """Run ``rows`` over the column lists of each Arrow batch; it yields column lists for ``schema``.

    Strings arrive as UTF-8 bytes. ``rows`` is called once per partition, so it can keep bounded state.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def lists(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            out = {}
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
                out[name] = column.to_pylist()
            yield out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for made in rows(lists(batches)):
                arrays = [pa.array(made[f.name], type=f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        finally:
            hand_back()

    return small_batches(df).mapInArrow(run, fields)


def extend_rows(
    df: DataFrame, inputs: list[str], added: str, start: Callable[[], Callable[[dict[str, list]], dict[str, list]]], drop: tuple[str, ...] = ()
) -> DataFrame:
    """Add the columns ``added`` (DDL) to each row, computed from the columns ``inputs``; the others pass untouched.

    ``start`` is called once per partition and gives the function for a batch. ``drop`` columns are left out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(added)
    kept = [f for f in df.schema if f.name not in {*new.names, *drop}]
    fields = StructType(kept + list(new))
    arrow = to_arrow_schema(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            work = start()
            for batch in batches:
                given = {}
                for name in inputs:
                    column = batch.column(batch.schema.names.index(name))
                    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
                    given[name] = column.to_pylist()
                made = work(given)
                arrays = [
                    pa.array(made[f.name], type=f.type) if f.name in made else batch.column(batch.schema.names.index(f.name)).cast(f.type)
                    for f in arrow
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        finally:
            hand_back()

    return small_batches(df).mapInArrow(run, fields)


def neutral(df: DataFrame, *keep: str) -> tuple[DataFrame, list[str]]:
    """The frame with columns other than ``keep`` renamed, so that no name clashes; and the names it had."""
    names = df.columns
    return df.toDF(*[c if c in keep else f"_own_{i}" for i, c in enumerate(names)]), names


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of characters other than space and \\x09-\\x0D."""
    return text.split() if text else []


class WordTable(dict):
    """64-bit hash of each word, kept while the worker lives and bounded in size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_TABLE_SIZE:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= WORD_BYTES:
            self[word] = value
        return value


WORDS = WordTable()


def hand_back() -> None:
    """Give back what a finished partition held: workers live on, idle ones beside the busy ones, with all they once took."""
    WORDS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), dtype=U64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` word hashes; none if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    with np.errstate(over="ignore"):
        out = np.full(n, U64(width), dtype=U64)
        for i in range(width):
            out = out * GOLDEN + hashes[i : i + n]
            out ^= out >> U64(29)
        return mixed(out)


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """The ``rows`` rows of least hash of ``key``: the same ones on every run.

    Rows are counted first, and those whose hash is far beyond the sample are left out where they are, so that what
    the tasks hand on is some twice the sample and does not grow with their number.
    """
    place = F.xxhash64(F.lit(seed), F.col(key))
    total = df.count()
    share = 2 * (rows + 100) / max(total, 1)
    near = df.filter(place < F.lit(int(share * 2**64) - 2**63)) if share < 1 else df
    if share < 1 and near.count() < rows:  # as good as never
        near = df
    return near.orderBy(place, F.col(key)).limit(rows)


#: Bins into which a pass of ``ranked`` deals the values that are left.
BINS = 4096


def ranked(df: DataFrame, column: str, rank: int) -> tuple[float, float]:
    """The value at ``rank`` (from 0, ascending) over all rows and the one after it; the last one is its own successor.

    Each pass counts the values left in ever narrower bins, so nothing is sorted or brought together.
    """
    low, high, left = df.agg(F.min(column), F.max(column), F.count(column)).first()
    after = None
    while low < high:
        bin_ = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(high - low) * BINS), F.lit(BINS - 1))
        counted = df.filter(F.col(column).between(low, high)).groupBy(bin_.alias("bin"))
        bins = sorted(counted.agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect())
        at = 0
        while rank >= bins[at]["n"]:
            rank -= bins[at]["n"]
            at += 1
        after = bins[at + 1]["low"] if at + 1 < len(bins) else after
        low, high, left = bins[at]["low"], bins[at]["high"], bins[at]["n"]
    return low, low if rank + 1 < left or after is None else after


def quantile(df: DataFrame, column: str, share: float, total: int) -> float:
    """``numpy.quantile`` of a column of ``total`` rows."""
    at = (total - 1) * share
    return float(np.quantile(ranked(df, column, int(at)), at - int(at)))


def lots(df: DataFrame, key: str, columns: list[str], draws: int, size: int, total: int, seed: int) -> list[np.ndarray]:
    """``draws`` random lots of ``size`` of all ``total`` rows: each lot follows a place of its own in the order of the keys' hashes."""
    starts = np.random.default_rng(seed).integers(0, 2**64, draws, dtype=U64)
    share = 2 * (size + 100) / total
    while True:
        width = U64(min(int(share * 2**64), 2**64 - 1))

        def near(batches: Iterator[dict[str, list]], width=width) -> Iterator[dict[str, list]]:
            kept: list[np.ndarray] = [np.empty((0, len(columns)))] * draws
            offs: list[np.ndarray] = [np.empty(0, dtype=U64)] * draws
            for batch in batches:
                place = np.array(batch["_place"], dtype=np.int64).view(U64)
                x = np.array([batch[c] for c in columns], dtype=np.float64).T.reshape(-1, len(columns))
                for t in range(draws):
                    off = place - starts[t]
                    at = np.flatnonzero(off <= width)
                    if len(at):
                        off, rows = np.concatenate([offs[t], off[at]]), np.concatenate([kept[t], x[at]])
                        order = np.argsort(off, kind="stable")[:size]
                        offs[t], kept[t] = off[order], rows[order]
            for t in range(draws):
                yield {"lot": [t] * len(offs[t]), "off": offs[t].view(np.int64).tolist(), "x": kept[t].tolist()}

        placed = df.select(F.xxhash64(F.lit(seed), F.col(key)).alias("_place"), *columns)
        found: list[list] = [[] for _ in range(draws)]
        for r in map_rows(placed, "lot int, off long, x array<double>", near).collect():
            found[r["lot"]].append((r["off"] % 2**64, r["x"]))
        if share >= 1 or min(map(len, found)) >= size:
            return [np.array([x for _, x in sorted(lot)[:size]]).reshape(-1, len(columns)) for lot in found]
        share *= 8
