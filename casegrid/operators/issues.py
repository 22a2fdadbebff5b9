"""Issue life cycle from append-only action logs: states, information requests, dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_after(action_type: Column, new_status: Column) -> Column:
    """Status an action sets; an upload sets none."""
    return (
        F.when(action_type == "dismissed", "dismissed")
        .when(action_type == "recheck", new_status)
        .when(action_type.isin("option_selection", "explanation_provided"), "awaiting_verification")
    )


def issue_states(actions: DataFrame) -> DataFrame:
    """Current state per issue as one combined aggregate; no issue's log is ever gathered.

    A recheck counts only after the issue has been opened by another action. A recheck is pending while
    the last upload is later than the last recheck.
    """
    kind, stamp = F.col("action_type"), F.struct("ts", "action_id")
    setting = F.struct("ts", "action_id", status_after(kind, F.col("new_status")).alias("status"))
    is_recheck, is_upload = kind == "recheck", kind == "document_upload"
    grouped = actions.groupBy("issue_id").agg(
        F.min(F.when(~is_recheck, stamp)).alias("opened"),
        F.max(F.when(~is_recheck & ~is_upload, setting)).alias("own"),
        F.max(F.when(is_recheck, setting)).alias("recheck"),
        F.max(F.when(is_upload, stamp)).alias("upload"),
        F.count_if(~is_recheck).alias("actions_taken"),
    )
    recheck_stamp = F.struct(F.col("recheck.ts").alias("ts"), F.col("recheck.action_id").alias("action_id"))
    valid = F.when(F.col("recheck").isNotNull() & (recheck_stamp > F.col("opened")), F.col("recheck"))
    last = F.greatest(F.col("own"), valid)
    valid_stamp = F.when(valid.isNotNull(), recheck_stamp)
    pending = F.col("upload").isNotNull() & (valid_stamp.isNull() | (F.col("upload") > valid_stamp))
    return grouped.where(F.col("opened").isNotNull()).select(
        "issue_id",
        F.coalesce(last["status"], F.lit("in_progress")).alias("status"),
        "actions_taken",
        pending.alias("recheck_pending"),
    )


def information_request_state(events: DataFrame, key: str, days: int = 21) -> DataFrame:
    """`needs_info` while a request is later than the last response; due date of the last request."""
    asked, answered = F.col("kind") == "request", F.col("kind") == "response"
    grouped = events.groupBy(key).agg(
        F.count_if(asked).alias("requests"),
        F.count_if(answered).alias("responses"),
        F.max(F.when(asked, F.col("ts"))).alias("last_request"),
        F.max(F.when(answered, F.col("ts"))).alias("last_response"),
    )
    waiting = F.col("last_request").isNotNull() & (
        F.col("last_response").isNull() | (F.col("last_response") < F.col("last_request"))
    )
    return grouped.select(
        key,
        "requests",
        "responses",
        F.when(waiting, "needs_info").otherwise("in_progress").alias("state"),
        F.date_format(F.date_add(F.to_date("last_request"), days), "yyyy-MM-dd").alias("due_on"),
    )


def dependency_state(dependencies: DataFrame, states: DataFrame) -> DataFrame:
    """Per issue with dependencies: how many there are, how many are open, and whether it is blocked.

    ``dependencies``: issue_id, depends_on. Unknown issues count as open.
    """
    known = states.select(F.col("issue_id").alias("depends_on"), (F.col("status") == "resolved").alias("resolved"))
    joined = dependencies.distinct().join(known, "depends_on", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    return joined.groupBy("issue_id").agg(
        F.count(F.lit(1)).alias("dependencies"),
        F.count_if(~F.col("resolved")).alias("open_dependencies"),
        (~F.bool_and("resolved")).alias("blocked"),
    )


def cascade_recheck(dependencies: DataFrame, states: DataFrame) -> DataFrame:
    """Dependents that become checkable because everything they wait for is resolved."""
    return dependency_state(dependencies, states).where(~F.col("blocked")).select("issue_id", "dependencies")
