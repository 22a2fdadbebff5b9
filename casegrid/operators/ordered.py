"""Running numbers, predecessors and running sums inside keys that may be very large.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. Here the order column is
cut into coarse, monotone buckets (a month, a day, a power of two): each (key, bucket) is a task of
its own and only one small row per (key, bucket) is combined along the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrid.session import cut_lineage

_BUCKET = "__bucket"


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = F.lit(True)
    for key in keys:
        cond = cond & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    kept = [F.col(f"r.{name}") for name in right.columns if name not in keys]
    return left.alias("l").join(right.alias("r"), cond).select("l.*", *kept)


def number_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    number: str | None = None,
    previous: dict[str, str] | None = None,
) -> DataFrame:
    """``row_number`` (1-based) and ``lag`` values inside ``keys`` ordered by ``order``.

    ``bucket`` must be non-decreasing in ``order[0]``; ``order`` must be a total order inside a key.
    ``previous`` maps an output name to the column whose previous value is wanted.
    """
    previous = previous or {}
    bucketed = df.withColumn(_BUCKET, bucket)
    last = [
        F.max(F.struct(*order, F.col(source).alias("__value"))).getField("__value").alias(f"__last_{name}")
        for name, source in previous.items()
    ]
    along = Window.partitionBy(*keys).orderBy(_BUCKET)
    summary = bucketed.groupBy(*keys, _BUCKET).agg(F.count(F.lit(1)).alias("__n"), *last)
    summary = summary.select(
        *keys,
        _BUCKET,
        F.coalesce(F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        *[F.lag(f"__last_{name}").over(along).alias(f"__prior_{name}") for name in previous],
    )
    joined = _null_safe_join(bucketed, summary, [*keys, _BUCKET])
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    if number:
        joined = joined.withColumn(number, F.col("__before") + F.row_number().over(inside))
    for name, source in previous.items():
        first = F.row_number().over(inside) == 1
        joined = joined.withColumn(name, F.when(first, F.col(f"__prior_{name}")).otherwise(F.lag(source).over(inside)))
    return joined.drop(_BUCKET, "__before", *[f"__prior_{name}" for name in previous])


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    value: str,
    out: str,
) -> DataFrame:
    """Sum of ``value`` up to and including each row, without one task per key."""
    bucketed = df.withColumn(_BUCKET, bucket)
    along = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        bucketed.groupBy(*keys, _BUCKET)
        .agg(F.sum(value).alias("__sum"))
        .select(*keys, _BUCKET, F.coalesce(F.sum("__sum").over(along), F.lit(0)).alias("__before"))
    )
    joined = _null_safe_join(bucketed, summary, [*keys, _BUCKET])
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.col("__before") + F.sum(value).over(inside)).drop(_BUCKET, "__before")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, as an aggregate: combined on the map side, so no hot task."""
    ordering = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    best = F.max(F.struct(*ordering, F.struct(*columns).alias("__row"))).getField("__row")
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, *[F.col(f"__best.{c}").alias(c) for c in columns])


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key. Spark limits each group before the shuffle, so at most k rows per task travel."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def global_running_sum(df: DataFrame, order: Sequence[str], value: str, out: str, parts: int | None = None) -> DataFrame:
    """Running sum over a whole table in ``order`` (a unique key), one range of rows per task.

    The ranges come from sampling, so their numbering is fixed by a checkpoint before it is used twice.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    along = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("__part")
        .agg(F.sum(value).alias("__sum"))
        .select("__part", F.coalesce(F.sum("__sum").over(along), F.lit(0)).alias("__before"))
    )
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(offsets, "__part")
    return joined.withColumn(out, F.col("__before") + F.sum(value).over(inside)).drop("__part", "__before")
