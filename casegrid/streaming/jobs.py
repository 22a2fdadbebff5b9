"""The same case operations over arriving rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from casegrid.functions.rule_catalog import FIELD_ALIASES
from casegrid.operators import extract as E
from casegrid.operators import rules as V
from casegrid.operators.issues import issue_states
from casegrid.operators.ordered import latest, number_within, running_sum

Writer = Callable[[DataFrame, int], None]


def findings_for(layouts: DataFrame, rules: DataFrame) -> DataFrame:
    """Layouts to findings without leaving the document's row; usable on a batch and on a stream batch alike."""
    found = E.with_field_map(E.extract(layouts, ["doc_id"]), FIELD_ALIASES)
    subjects = found.select(
        F.col("doc_id").alias("document_id"),
        F.col("doc_id").alias("submission_id"),
        "document_type",
        "application_type",
        "fields",
        F.array("document_type").alias("present_types"),
        F.lit("V0").alias("submission_version"),
    )
    return V.evaluate_rules(subjects, None, rules)


def stream_findings(layouts: DataFrame, rules: DataFrame, write: Writer, checkpoint: str):
    """Each micro-batch of arriving layouts is extracted and validated; ``write`` must be idempotent per batch id."""

    def step(batch: DataFrame, batch_id: int) -> None:
        write(findings_for(batch, rules), batch_id)

    return layouts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def first_arrivals(files: DataFrame, delay: str = "7 days") -> DataFrame:
    """Drop files whose content hash arrived before, with state bounded by the watermark."""
    return files.withWatermark("uploaded_at", delay).dropDuplicatesWithinWatermark(["content_hash"])


def run_status(events: DataFrame) -> DataFrame:
    """Latest status per run; a stream keeps one row of state per run."""
    last = F.max(F.struct("ts", "event_id", "status"))
    return events.groupBy("run_id").agg(last["status"].alias("status"), last["ts"].alias("updated_at"), F.count(F.lit(1)).alias("events"))


def live_issue_states(actions: DataFrame) -> DataFrame:
    """Issue states are a plain aggregate, so batch and stream share it; hot issues combine on the map side."""
    return issue_states(actions)


def spend(calls: DataFrame, budget: float) -> DataFrame:
    """Total cost so far per scope and whether it is over budget."""
    return calls.groupBy("scope").agg(F.sum("cost_usd").alias("total")).withColumn("over_budget", F.col("total") > budget)


def daily_counts(rows: DataFrame, ts: str, *keys: str, delay: str = "2 days") -> DataFrame:
    day = F.window(ts, "1 day")
    return rows.withWatermark(ts, delay).groupBy(day.alias("day"), *keys).agg(F.count(F.lit(1)).alias("n"))


def upsert_latest(snapshot: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """New snapshot: the newest row per key of the old snapshot and the batch."""
    columns = [c for c in snapshot.columns if c not in keys]
    united = snapshot.unionByName(batch.select(snapshot.columns))
    return latest(united, list(keys), [F.col(c) for c in order], columns)


class UpsertLog:
    """The newest row per key, kept as runs of batches under ``folder`` and merged when read.

    Batch n is written as a run of its own, reduced to its newest row per key. Whenever ``fanout`` runs of one length
    are full, they are merged into one run ``fanout`` times as long, so a row is written once per length: bytes follow
    the batches and the logarithm of their number, not the size of the whole. Which runs a batch writes follows from its
    number alone and an incomplete one is overwritten, so a batch that is run again after a failure leaves the same runs.
    A run counts once Spark has marked it complete; a reader takes the longest complete runs and may read while batches
    are written. Rows equal in ``order`` are decided by their other columns, the greatest first. Null keys are keys.
    ``expire`` deletes runs that a longer one covers; no reader of an older state may be at work then.
    """

    def __init__(self, folder: str, keys: Sequence[str], order: Sequence[str], fanout: int = 8):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.folder, self.keys, self.order, self.fanout = folder.rstrip("/"), list(keys), list(order), fanout

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``; batch ids start at 0 and have no gaps. Runs that are complete are left as they are."""
        spark, lengths = batch.sparkSession, [1]
        while (batch_id + 1) % (lengths[-1] * self.fanout) == 0:
            lengths.append(lengths[-1] * self.fanout)
        done = max((n for n in lengths if self._complete(spark, batch_id + 1 - n, n)), default=0)
        if done == 0:
            self._put(batch, batch_id, 1)
        for length in [n for n in lengths if n > max(done, 1)]:
            first, part = batch_id + 1 - length, length // self.fanout
            parts = self._rows(spark, [(first + i * part, part) for i in range(self.fanout)], batch.schema)
            self._put(parts, first, length)

    def current(self, spark: SparkSession, batch_id: int, schema: StructType) -> DataFrame:
        """The state after batch ``batch_id``. Filters on the keys reach the scans of all runs."""
        return self._newest(self._rows(spark, self.runs(spark, batch_id), schema))

    def runs(self, spark: SparkSession, batch_id: int) -> list[tuple[int, int]]:
        """(first batch, length) of the longest complete runs that cover all batches up to ``batch_id``."""
        found, first = [], 0
        while first <= batch_id:
            length = 1
            while first % (length * self.fanout) == 0 and first + length * self.fanout <= batch_id + 1:
                length *= self.fanout
            while length > 1 and not self._complete(spark, first, length):
                length //= self.fanout
            if length == 1 and not self._complete(spark, first, 1):
                raise FileNotFoundError(f"batch {first} has not been written to {self.folder}")
            found.append((first, length))
            first += length
        return found

    def expire(self, spark: SparkSession, batch_id: int) -> int:
        """Delete the runs inside the ones that the state after ``batch_id`` reads; how many there were."""
        deleted = 0
        for first, length in self.runs(spark, batch_id):
            part = length // self.fanout
            while part:
                deleted += sum(self._delete(spark, at, part) for at in range(first, first + length, part))
                part //= self.fanout
        return deleted

    def _path(self, first: int, length: int) -> str:
        return f"{self.folder}/length-{length}/first-{first}"

    def _rows(self, spark: SparkSession, runs: Sequence[tuple[int, int]], schema: StructType) -> DataFrame:
        return spark.read.schema(schema).parquet(*[self._path(*run) for run in runs])

    def _newest(self, rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c not in self.keys]
        return latest(rows, self.keys, [F.col(c) for c in self.order], columns).select(rows.columns)

    def _put(self, rows: DataFrame, first: int, length: int) -> None:
        self._newest(rows).write.mode("overwrite").parquet(self._path(first, length))

    def _place(self, spark: SparkSession, first: int, length: int, name: str = ""):
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self._path(first, length)}/{name}".rstrip("/"))
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def _complete(self, spark: SparkSession, first: int, length: int) -> bool:
        files, mark = self._place(spark, first, length, "_SUCCESS")
        return files.exists(mark)

    def _delete(self, spark: SparkSession, first: int, length: int) -> bool:
        files, path = self._place(spark, first, length)
        return files.delete(path, True)


def upsert_writer(folder: str, keys: Sequence[str], order: Sequence[str], fanout: int = 8) -> Writer:
    """A ``foreachBatch`` function that keeps the newest row per key; read with ``UpsertLog(...).current``."""
    return UpsertLog(folder, keys, order, fanout).write


# ---- alert throttle ----------------------------------------------------------------------------


class _Limiter:
    """At most ``most`` sent alerts in any trailing ``window`` seconds; only sent ones count."""

    def __init__(self, window: float, most: int, sent: Sequence[float] = ()):
        self.window, self.most, self.sent = window, most, deque(sent)

    def admit(self, second: float) -> bool:
        while self.sent and self.sent[0] <= second - self.window:
            self.sent.popleft()
        if len(self.sent) >= self.most:
            return False
        self.sent.append(second)
        return True


def throttle(alerts: DataFrame, window: int = 60, most: int = 10) -> DataFrame:
    """Which alerts are sent. ``alerts``: limiter, alert_id, ts.

    A pause of a whole window empties the limiter, so stretches between pauses are independent: each is
    one sorted run inside a task, read batch by batch with a state of ``most`` times.
    """
    second = F.col("ts").cast("double")
    base = alerts.select("limiter", "alert_id", "ts", second.alias("second"))
    hour = F.date_trunc("hour", "ts")
    gaps = number_within(base, ["limiter"], ["ts", "alert_id"], hour, previous={"before": "second"})
    fresh = F.when(F.col("before").isNull() | (F.col("second") - F.col("before") >= window), 1).otherwise(0)
    runs = running_sum(gaps.withColumn("fresh", fresh), ["limiter"], ["ts", "alert_id"], hour, "fresh", "stretch")
    ordered = runs.select("limiter", "stretch", "alert_id", "second").repartition("limiter", "stretch").sortWithinPartitions(
        "limiter", "stretch", "second", "alert_id"
    )

    def pass_through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, limiter = None, _Limiter(window, most)
        for batch in batches:
            sent = []
            for name, stretch, at in zip(batch["limiter"], batch["stretch"], batch["second"]):
                if (name, stretch) != current:
                    current, limiter = (name, stretch), _Limiter(window, most)
                sent.append(limiter.admit(at))
            yield pd.DataFrame({"limiter": batch["limiter"], "alert_id": batch["alert_id"], "sent": sent})

    return ordered.mapInPandas(pass_through, "limiter string, alert_id long, sent boolean")


def throttle_stream(alerts: DataFrame, window: int = 60, most: int = 10) -> DataFrame:
    """Stream form: the state per limiter is the times of the alerts sent last."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        limiter = _Limiter(window, most, state.get[0] if state.exists else ())
        rows = pd.concat(list(batches)).sort_values(["second", "alert_id"])
        sent = [limiter.admit(at) for at in rows["second"]]
        state.update((list(limiter.sent),))
        yield pd.DataFrame({"limiter": rows["limiter"], "alert_id": rows["alert_id"], "sent": sent})

    staged = alerts.select("limiter", "alert_id", F.col("ts").cast("double").alias("second"))
    return staged.groupBy("limiter").applyInPandasWithState(
        step, "limiter string, alert_id long, sent boolean", "sent array<double>", "append", GroupStateTimeout.NoTimeout
    )
