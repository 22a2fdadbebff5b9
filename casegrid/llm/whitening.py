"""Whitening of vectors by covariances recovered from variances of single dimensions and of sums of two.

Each entry c becomes the integer x = floor(256 * c), so that every sum is exact. The fit list is each distinct x vector
once. One pass gives its length n and the sums S. A second pass adds up, for every dimension and every sum of two
dimensions, the squares of its centred values; the polarisation identity cov(a, b) = (var(a + b) - var(a) - var(b)) / 2
then gives all cross-covariances. No product of two different dimensions is ever formed. Tasks add up in integers: they
centre by m = floor(S / n), and the rest r = S - n * m is put back exactly: the squares of n * x - S are n * n times
those of x - m, less n * r * r. Batches whose squares could pass 64 bits are added up in unbounded integers.

The driver holds one number per pair of dimensions, never rows; the eigenvectors of that matrix go to the tasks. The
fit list is written to the shared folder, so later passes read it and a lost executor costs only its own tasks.

Null vectors and vectors that hold null or non-finite entries give no rows; nor do empty ones, or those of another
length than most of the fit list has (the shorter length if two are as common). 256 * c beyond 64 bits counts as the
nearest end of that range. Repeated vectors count once for the fit and are all whitened. Null ids stay null. Where the
fit list has fewer independent directions than components asked for, the components beyond have null ``whitened``.
``deviation`` is null where the exact number passes 64 bits; ``deviation_digits`` has it then, and is null otherwise.
An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import require, small_batches
from casegrid.session import cut_lineage

#: Steps of the integer grid in one unit.
GRID = 256
SAFE = 1 << 62
SUMS = "a int, b int, high decimal(38,0), low decimal(38,0)"


@dataclass
class Fit:
    """What the tasks need: n, the integer centres and rests of each dimension, unit eigenvectors and eigenvalues."""

    n: int
    centre: list[int]
    rest: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    rank: int


def on_grid(vector: Column) -> Column:
    """The integer vector; null unless every entry is a finite number."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.when(finite, F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(GRID)))))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column(batch.schema.names.index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _centred(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """x less the centres: 64-bit where that is safe, else unbounded integers."""
    if not len(x) or max(abs(int(x.max())), abs(int(x.min())), *map(abs, centre)) < SAFE >> 1:
        return x - np.array(centre, dtype=np.int64)
    return x.astype(object) - np.array(centre, dtype=object)


def _reach(d: np.ndarray) -> int:
    return max(abs(int(d.max())), abs(int(d.min()))) if d.size else 0


def pair_squares(d: np.ndarray) -> list[np.ndarray]:
    """For each dimension a: the sums of squares of a itself and of its sums with every later dimension."""
    if d.dtype != object and 4 * _reach(d) ** 2 * max(len(d), 1) >= SAFE:
        d = d.astype(object)
    out = []
    for a in range(d.shape[1]):
        both = d[:, a:] + d[:, a : a + 1]
        both[:, 0] = d[:, a]
        out.append((both * both).sum(axis=0))
    return out


def _sums(fit_list: DataFrame, dims: int, of_batch: Callable[[np.ndarray], dict[tuple[int, int], int]]) -> dict[tuple[int, int], int]:
    """Exact totals over the fit list of the numbers that ``of_batch`` gives for a block of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            for key, value in of_batch(_matrix(batch, dims)).items():
                total[key] = total.get(key, 0) + value
        keys = list(total)
        halves = [divmod(total[k], 1 << 64) for k in keys]
        wide = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([a for a, _ in keys], pa.int32()),
                pa.array([b for _, b in keys], pa.int32()),
                pa.array([Decimal(h) for h, _ in halves], wide),
                pa.array([Decimal(low) for _, low in halves], wide),
            ],
            names=["a", "b", "high", "low"],
        )

    parts = small_batches(fit_list).mapInArrow(run, SUMS)
    rows = parts.groupBy("a", "b").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()  # one row per pair of dimensions
    return {(r.a, r.b): (int(r.high) << 64) + int(r.low) for r in rows}


def covariance(n: int, rest: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariances of the dimensions, each rounded once, from exact sums of squares of x less its integer centre."""
    dims = len(rest)

    def exact(a: int, b: int) -> int:  # of n * x - S, for the dimension a or the sum of a and b
        r = rest[a] if a == b else rest[a] + rest[b]
        return n * n * squares[a, b] - n * r * r

    out = np.empty((dims, dims))
    single = [exact(a, a) for a in range(dims)]
    for a in range(dims):
        out[a, a] = single[a] / n**3
        for b in range(a + 1, dims):
            out[a, b] = out[b, a] = (exact(a, b) - single[a] - single[b]) / (2 * n**3)
    return out


def fit(fit_list: DataFrame, dims: int) -> Fit:
    """Covariance and eigenvectors of the distinct vectors ``x`` of ``dims`` entries."""

    def totals(x: np.ndarray) -> dict[tuple[int, int], int]:
        wide = x.astype(object) if _reach(x) * max(len(x), 1) >= SAFE else x
        return {(a, 0): int(v) for a, v in enumerate(wide.sum(axis=0))} | {(-1, -1): len(x)}

    found = _sums(fit_list, dims, totals)
    n = found[-1, -1]
    halves = [divmod(found[a, 0], n) for a in range(dims)]
    centre, rest = [q for q, _ in halves], [r for _, r in halves]

    def squares(x: np.ndarray) -> dict[tuple[int, int], int]:
        return {(a, a + i): int(v) for a, row in enumerate(pair_squares(_centred(x, centre))) for i, v in enumerate(row)}

    v = covariance(n, rest, _sums(fit_list, dims, squares))
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(dims)] < 0, -1.0, 1.0)
    rank = int((values > dims * np.finfo(float).eps * max(values[0], 0)).sum())
    return Fit(n, centre, rest, vectors, values, float(np.trace(v)), rank)


def _projected(model: Fit, d: np.ndarray, components: int) -> np.ndarray:
    offsets = d.astype(float) - np.array([r / model.n for r in model.rest])
    return offsets @ (model.vectors[:, :components] / np.sqrt(model.values[:components]))


def _identity_error(model: Fit, fit_list: DataFrame, dims: int, components: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list, less the identity."""
    k = min(components, model.rank)
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = _projected(model, _centred(_matrix(batch, dims), model.centre), k)
            once, twice = once + w.sum(axis=0), twice + w.T @ w
        rows = [(a, -1, once[a]) for a in range(k)] + [(a, b, twice[a, b]) for a in range(k) for b in range(k)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["a", "b", "total"]
        )

    parts = small_batches(fit_list).mapInArrow(run, "a int, b int, total double")
    total = {(r.a, r.b): r.total / model.n for r in parts.groupBy("a", "b").agg(F.sum("total").alias("total")).collect()}
    return max(abs(total[a, b] - total[a, -1] * total[b, -1] - (a == b)) for a in range(k) for b in range(k))


def _deviations(model: Fit, d: np.ndarray) -> tuple[list[int | None], list[str | None]]:
    """Sum of (n * x - S) squared of each row: as a 64-bit number, or as digits where it passes that."""
    n, rest = model.n, model.rest
    if d.dtype != object and max(_reach(d), *rest) * (_reach(d) + 1) * d.shape[1] >= SAFE:
        d = d.astype(object)
    own = (d * d).sum(axis=1).tolist()
    cross = (d * np.array(rest, dtype=d.dtype)).sum(axis=1).tolist()
    last = sum(r * r for r in rest)
    exact = [n * n * a - 2 * n * b + last for a, b in zip(own, cross, strict=True)]
    fits = [v < 1 << 63 for v in exact]
    return [v if ok else None for v, ok in zip(exact, fits, strict=True)], [None if ok else str(v) for v, ok in zip(exact, fits, strict=True)]


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """One row per vector and component: ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    require(df, key, vector)
    kind = df.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"
    )
    rows = df.select(F.col(key), on_grid(F.col(vector)).alias("x")).filter(F.size("x") > 0)
    fit_list = cut_lineage(rows.select("x").distinct())
    common = fit_list.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        return df.sparkSession.createDataFrame([], schema)
    dims = common.dims
    fit_list = fit_list.filter(F.size("x") == dims)
    model = fit(fit_list, dims)
    error = _identity_error(model, fit_list, dims, components)
    k, usable = min(components, dims), min(components, dims, model.rank)
    explained = [float(max(e, 0) / model.trace) if model.trace else None for e in model.values[:k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _centred(_matrix(batch, dims), model.centre)
            deviation, digits = _deviations(model, d)
            white = np.full((len(d), k), np.nan)
            if usable:
                white[:, :usable] = _projected(model, d, usable)
            times = np.repeat(np.arange(len(d)), k)
            number = np.tile(np.arange(1, k + 1, dtype=np.int32), len(d))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.names.index(key)).take(pa.array(times)),
                    pa.array(number),
                    pa.array(np.full(len(number), model.n, dtype=np.int64)),
                    pa.array(deviation, pa.int64()).take(pa.array(times)),
                    pa.array(white.ravel(), mask=number > usable),
                    pa.array(explained, pa.float64()).take(pa.array(number - 1)),
                    pa.array([error] * len(number), pa.float64()),
                    pa.array(digits, pa.string()).take(pa.array(times)),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"],
            )

    return small_batches(rows.filter(F.size("x") == dims)).mapInArrow(run, schema)


__all__ = ["Fit", "covariance", "fit", "on_grid", "pair_squares", "whiten"]
