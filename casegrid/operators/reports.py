"""Search, list, comparison, review and KPI reports over the case tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrid.functions.codes import is_issue, normalise_status, ratio
from casegrid.operators.ordered import latest, number_within, top_per_key

STATUSES = ("pass", "fail", "needs_review")


# ---- filters -----------------------------------------------------------------------------------


def ilike_any(text: str | None, *cols: str) -> Column:
    """Case-insensitive substring match on any of the columns; wildcards in the text are literal."""
    if not text:
        return F.lit(True)
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{escaped}%"), F.lit(False)) for c in cols])


def equal_to(filters: Mapping[str, object] | None) -> Column:
    """Conjunction of equality filters; empty values are ignored."""
    conds = [F.col(k) == v for k, v in (filters or {}).items() if v not in (None, "")]
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def in_range(col: str, low=None, high=None) -> Column:
    cond = F.lit(True)
    if low is not None:
        cond = cond & (F.col(col) >= F.lit(low))
    if high is not None:
        cond = cond & (F.col(col) <= F.lit(high))
    return cond


def preset_range(col: str, preset: str, as_of: Column, start=None, end=None) -> Column:
    """Calendar presets: all, today, last_7_days, last_30_days, custom (end day inclusive)."""
    value = F.col(col)
    if preset == "today":
        return value >= F.date_trunc("day", as_of)
    if preset == "last_7_days":
        return value >= as_of - F.expr("INTERVAL 7 DAYS")
    if preset == "last_30_days":
        return value >= as_of - F.expr("INTERVAL 30 DAYS")
    if preset == "custom":
        closing = F.date_trunc("day", F.lit(end).cast("timestamp")) + F.expr("INTERVAL 1 DAY")
        return (value >= F.lit(start).cast("timestamp")) & (value < closing)
    return F.lit(True)


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 50) -> DataFrame:
    """One page of an ordered result. The order must end in a unique column."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def with_total(df: DataFrame, matched: DataFrame) -> DataFrame:
    """Attach the number of matched rows before paging as a scalar subquery."""
    return df.withColumn("total_count", matched.select(F.count(F.lit(1))).scalar())


def search_fields(
    fields: DataFrame,
    name: str | None = None,
    value: str | None = None,
    filters: Mapping[str, object] | None = None,
    number: int = 1,
    size: int = 50,
) -> DataFrame:
    """Extracted fields by exact name, part of the value and equal keys: one page, oldest first, with the total."""
    wanted = ilike_any(value, "field_value") & equal_to(filters) & equal_to({"field_name": name})
    matched = fields.where(wanted)
    order = [F.col(c) for c in ("created_at", "submission_id", "document_id", "field_name")]
    columns = ["submission_id", "document_id", "field_name", "field_value", "confidence", "created_at"]
    return with_total(page(matched, order, number, size).select(*columns), matched)


# ---- counts ------------------------------------------------------------------------------------


def status_counts(checks: DataFrame, *keys: str) -> DataFrame:
    return checks.groupBy(*keys).agg(
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in STATUSES], F.count(F.lit(1)).alias("total_count")
    )


def lenient_summary(checks: DataFrame, *keys: str) -> DataFrame:
    """Counts by status where anything unknown goes to review."""
    status = normalise_status(F.col("status"))
    known = {"pass": ["pass", "passed"], "fail": ["fail", "failed"], "warning": ["warning"]}
    named = [F.count_if(status.isin(values)).alias(name) for name, values in known.items()]
    rest = ~status.isin([v for values in known.values() for v in values])
    return checks.groupBy(*keys).agg(*named, F.count_if(rest).alias("needs_review"))


def latest_submissions(submissions: DataFrame) -> DataFrame:
    columns = ["id", "submission_version", "status", "created_at", "parent_submission_id"]
    rows = latest(submissions, ["application_id"], [F.col("created_at"), F.col("id")], columns)
    return rows.withColumnRenamed("id", "submission_id").withColumnRenamed("created_at", "submitted_at")


def search_applications(
    applications: DataFrame,
    submissions: DataFrame,
    checks: DataFrame,
    text: str | None = None,
    filters: Mapping[str, object] | None = None,
    date_from=None,
    date_to=None,
    number: int = 1,
    size: int = 50,
) -> DataFrame:
    """Matching applications, one page, with latest submission and its check counts."""
    matched = applications.where(
        ilike_any(text, "application_ref", "applicant_name") & equal_to(filters) & in_range("created_at", date_from, date_to)
    )
    shown = page(matched, [F.col("id")], number, size)
    ours = submissions.join(shown.select(F.col("id").alias("application_id")), "application_id", "left_semi")
    newest = latest_submissions(ours)
    counts = status_counts(checks.join(newest.select("submission_id"), "submission_id", "left_semi"), "submission_id")
    joined = (
        shown.select(F.col("id").alias("application_id"), "application_ref", "applicant_name", "created_at")
        .join(newest.select("application_id", "submission_id", "submission_version"), "application_id", "left")
        .join(counts.withColumnRenamed("total_count", "check_count"), "submission_id", "left")
    )
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("pass_count", "fail_count", "needs_review_count", "check_count")]
    result = joined.select(
        "application_id", "application_ref", "applicant_name", "created_at", "submission_id", "submission_version", *filled
    )
    return with_total(result, matched)


def search_submissions(
    submissions: DataFrame,
    applications: DataFrame,
    checks: DataFrame,
    text: str | None = None,
    filters: Mapping[str, object] | None = None,
    number: int = 1,
    size: int = 50,
) -> DataFrame:
    names = applications.select(F.col("id").alias("application_id"), "application_ref", "applicant_name")
    joined = submissions.select(
        F.col("id").alias("submission_id"), "application_id", "submission_version", "status", "created_at"
    ).join(names, "application_id")
    matched = joined.where(ilike_any(text, "application_ref", "applicant_name", "submission_version") & equal_to(filters))
    shown = page(matched, [F.col("created_at").desc(), F.col("submission_id").desc()], number, size)
    counts = status_counts(checks.join(shown.select("submission_id"), "submission_id", "left_semi"), "submission_id")
    result = shown.join(counts.withColumnRenamed("total_count", "check_count"), "submission_id", "left")
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("pass_count", "fail_count", "needs_review_count", "check_count")]
    return with_total(
        result.select("submission_id", "application_ref", "submission_version", "status", "created_at", *filled), matched
    )


def case_list(applications: DataFrame, submissions: DataFrame, checks: DataFrame, change_sets: DataFrame, runs: DataFrame) -> DataFrame:
    """Every application with its latest submission, derived status, change counts and latest run."""
    newest = latest_submissions(submissions)
    counts = status_counts(checks, "submission_id").select(
        "submission_id", F.col("fail_count").alias("issues"), F.col("needs_review_count").alias("warnings")
    )
    parents = submissions.select(F.col("id").alias("parent_submission_id"), F.col("submission_version").alias("parent_version"))
    last_run = latest(
        runs.where(F.col("application_id").isNotNull()), ["application_id"], [F.col("started_at"), F.col("run_id")], ["run_id"]
    )
    changes = change_sets.select("submission_id", "field_changes", "document_changes")
    joined = (
        newest.join(
            applications.select(F.col("id").alias("application_id"), "application_ref", "applicant_name", "created_at"),
            "application_id",
        )
        .join(counts, "submission_id", "left")
        .join(parents, "parent_submission_id", "left")
        .join(changes, "submission_id", "left")
        .join(last_run, "application_id", "left")
    )
    issues, warnings = F.coalesce("issues", F.lit(0)), F.coalesce("warnings", F.lit(0))
    is_modification = F.col("parent_version").isNotNull()
    status = (
        F.when(F.col("status") != "completed", "Processing")
        .when(issues > 0, "Issues Found")
        .when(warnings > 0, "In Review")
        .otherwise("Complete")
    )
    changed = {c: F.when(is_modification, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)) for c in ("field_changes", "document_changes")}
    return joined.select(
        "application_id",
        F.concat_ws("-", "application_ref", "submission_version").alias("display_ref"),
        F.when(is_modification, F.concat_ws("-", "application_ref", "parent_version")).alias("parent_ref"),
        F.coalesce("applicant_name", F.lit("Unknown")).alias("applicant"),
        status.alias("status"),
        F.date_format("submitted_at", "yyyy-MM-dd").alias("submitted_on"),
        F.date_format("created_at", "yyyy-MM-dd").alias("original_date"),
        issues.alias("issues"),
        warnings.alias("warnings"),
        is_modification.alias("is_modification"),
        *[c.cast("long").alias(name) for name, c in changed.items()],
        "submission_id",
        "run_id",
    )


def headline(applications: DataFrame, submissions: DataFrame, checks: DataFrame, low=None, high=None) -> DataFrame:
    """One row of dashboard figures for a period; cases and checks are scalar subqueries, one scan each."""
    cases = applications.where(in_range("created_at", low, high)).select(F.count(F.lit(1))).scalar()
    subs = submissions.where(in_range("created_at", low, high)).agg(
        F.count(F.lit(1)).alias("total_submissions"),
        F.count_if(F.col("submission_version") != "V0").alias("modifications"),
        F.count_if(F.col("parent_submission_id").isNotNull()).alias("revisions"),
    )
    counts = F.struct(*[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in STATUSES])
    counted = checks.where(in_range("created_at", low, high)).agg(counts.alias("counts")).scalar()
    base = subs.withColumn("total_cases", cases).withColumn("counts", counted).select("*", "counts.*")
    total = F.col("pass_count") + F.col("fail_count") + F.col("needs_review_count")
    return base.withColumn("total_checks", total).select(
        "total_cases",
        "total_submissions",
        "revisions",
        "total_checks",
        "pass_count",
        "fail_count",
        "needs_review_count",
        F.round(ratio(F.col("pass_count"), F.col("total_checks"), 100.0), 4).alias("pass_rate"),
        F.round(ratio(F.col("total_checks"), F.col("total_submissions")), 4).alias("avg_checks_per_submission"),
        F.round(ratio(F.col("total_submissions"), F.col("total_cases")), 4).alias("avg_submissions_per_case"),
        F.round(ratio(F.col("modifications"), F.col("total_submissions"), 100.0), 4).alias("modification_rate"),
    )


def top_failing_rules(checks: DataFrame, limit: int = 10) -> DataFrame:
    return (
        checks.where(F.col("status") == "fail")
        .groupBy("rule_id")
        .agg(F.count(F.lit(1)).alias("fail_count"))
        .orderBy(F.desc("fail_count"), "rule_id")
        .limit(limit)
    )


def override_statistics(overrides: DataFrame) -> DataFrame:
    return overrides.groupBy(F.coalesce("officer_id", F.lit("Unknown")).alias("officer")).agg(
        F.count(F.lit(1)).alias("override_count")
    )


def override_history(overrides: DataFrame) -> DataFrame:
    """Every override of each check with its place, newest first.

    The place is the number of overrides of the check less the rank from the oldest; both come from daily counts, so
    a check with very many overrides is not one task.
    """
    ranked = number_within(overrides, ["check_id"], ["created_at", "override_id"], F.date_trunc("day", "created_at"), number="__from_oldest")
    sizes = overrides.groupBy("check_id").agg(F.count(F.lit(1)).alias("__n"))
    placed = ranked.join(sizes, "check_id").withColumn("place", F.col("__n") - F.col("__from_oldest") + 1)
    return placed.drop("__n", "__from_oldest")


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """Feedback on evidence after all upserts: the newest per check, document, page and reviewer."""
    keys = ["validation_check_id", "document_id", "page_number", "reviewer_id"]
    return latest(feedback, keys, [F.col("created_at"), F.col("feedback_id")], ["is_relevant", "created_at"])


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """Per check: pages judged, and how many reviewers found relevant or not."""
    return latest_feedback(feedback).groupBy("validation_check_id").agg(
        F.count(F.lit(1)).alias("judgements"),
        F.count_if("is_relevant").alias("relevant"),
        F.count_if(~F.col("is_relevant")).alias("irrelevant"),
    )


def duplicate_hashes(documents: DataFrame) -> DataFrame:
    """Documents whose content occurs more than once, one row each with the size of its group.

    The copies stay rows: a popular hash would not fit into one list.
    """
    sizes = documents.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    return documents.join(sizes, "content_hash").select("content_hash", "copies", "document_id", "filename")


def ingest_duplicates(documents: DataFrame) -> DataFrame:
    """Each document with the first holder of its content; later holders are duplicates to relink."""
    first = documents.groupBy("content_hash").agg(
        F.min(F.struct("uploaded_at", "document_id")).getField("document_id").alias("kept_document_id")
    )
    joined = documents.join(first, "content_hash")
    return joined.select(
        "document_id", "submission_id", "kept_document_id", (F.col("document_id") != F.col("kept_document_id")).alias("is_duplicate")
    )


# ---- field views -------------------------------------------------------------------------------


def best_fields(fields: DataFrame, *keys: str) -> DataFrame:
    """Per key and field the value with the highest confidence (missing last), then the newest."""
    order = [F.coalesce("confidence", F.lit(-1.0)), F.col("created_at"), F.col("document_id")]
    return latest(fields, [*keys, "field_name"], order, ["field_value", "confidence", "extractor", "field_unit"])


def field_view(fields: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """Per submission and field: conflict flag over non-empty values, entry count, chosen resolution."""
    per_value = fields.groupBy("submission_id", "field_name", "field_value").agg(F.count(F.lit(1)).alias("uses"))
    filled = F.coalesce(F.col("field_value") != "", F.lit(False))
    view = per_value.groupBy("submission_id", "field_name").agg(
        F.count_if(filled).alias("value_count"), F.sum("uses").alias("entry_count")
    )
    view = view.withColumn("has_conflict", F.col("value_count") > 1)
    if resolutions is None:
        return view
    chosen = latest(resolutions, ["submission_id", "field_name"], [F.col("created_at"), F.col("officer_id")], ["chosen_value", "officer_id"])
    return view.join(chosen, ["submission_id", "field_name"], "left")


def conflict_options(fields: DataFrame, sources: int = 2) -> DataFrame:
    """One row per distinct value of a clashing field: how often it occurs and its first sources."""
    per_value = fields.groupBy("submission_id", "field_name", "field_value").agg(F.count(F.lit(1)).alias("occurrences"))
    first = top_per_key(fields, ["submission_id", "field_name", "field_value"], [F.col("document_id")], sources)
    lists = first.groupBy("submission_id", "field_name", "field_value").agg(
        F.array_join(F.array_sort(F.collect_list("document_id")), ",").alias("first_sources")
    )
    # united and grouped rather than joined: rows dealt by submission stay where they are
    none = F.lit(None)
    both = per_value.withColumn("first_sources", none.cast("string")).unionByName(lists.withColumn("occurrences", none.cast("long")))
    values = both.groupBy("submission_id", "field_name", "field_value").agg(F.max("occurrences").alias("occurrences"), F.max("first_sources").alias("first_sources"))
    counted = values.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("submission_id", "field_name")))
    return counted.where("n > 1 AND submission_id IS NOT NULL AND field_name IS NOT NULL").drop("n")


def effective_fields(extracted: DataFrame, answers: DataFrame) -> DataFrame:
    """Reviewer answers entered as fields with confidence 1.0 win over extraction."""
    given = answers.select(
        "submission_id",
        "document_id",
        "field_name",
        "field_value",
        F.lit(None).cast("string").alias("field_unit"),
        F.lit(1.0).alias("confidence"),
        F.lit("user").alias("extractor"),
        "created_at",
    )
    return best_fields(extracted.unionByName(given), "submission_id")


def merged_resolved(layers: Sequence[DataFrame], newest_wins: bool = False) -> DataFrame:
    """Resolved fields from several scopes: a later layer wins; inside a layer the oldest value wins.

    Each layer: key, field_name, field_value, resolved_at.
    """
    parts = []
    for level, layer in enumerate(layers):
        stamp = F.col("resolved_at").cast("double")
        order = [stamp if newest_wins else -stamp, F.col("field_value")]
        parts.append(latest(layer, ["key", "field_name"], order, ["field_value"]).withColumn("level", F.lit(level)))
    united = reduce(lambda a, b: a.unionByName(b), parts)
    return latest(united, ["key", "field_name"], [F.col("level")], ["field_value", "level"])


def enriched_applications(applications: DataFrame, submissions: DataFrame, fields: DataFrame, upgrades: Mapping[str, str]) -> DataFrame:
    """Blank application columns filled from the best extracted field of any of its submissions."""
    owners = submissions.select(F.col("id").alias("submission_id"), "application_id")
    wanted = fields.where(F.col("field_name").isin(list(upgrades)) & F.coalesce(F.col("field_value") != "", F.lit(False)))
    best = best_fields(wanted.join(owners, "submission_id"), "application_id")
    wide = best.groupBy("application_id").agg(
        *[F.max(F.when(F.col("field_name") == f, F.col("field_value"))).alias(f"best_{f}") for f in upgrades]
    )
    joined = applications.join(wide.withColumnRenamed("application_id", "id"), "id", "left")
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"best_{f}")) for f, c in upgrades.items()}
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in applications.columns])


def upsert_blanks(existing: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Insert unknown keys; for known ones fill only blank columns."""
    new = incoming.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = existing.select(key, *columns).join(new, key, "full")
    return joined.select(key, *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}")).alias(c) for c in columns])


# ---- run reports -------------------------------------------------------------------------------


def run_documents(runs: DataFrame, bridge: DataFrame) -> DataFrame:
    """(run_id, document_id): the linked documents, else the run's own document."""
    linked = bridge.select("run_id", "document_id").distinct()
    alone = runs.select("run_id", "document_id").where(F.col("document_id").isNotNull())
    return linked.unionByName(alone.join(linked, "run_id", "left_anti"))


def run_history(runs: DataFrame, links: DataFrame, checks: DataFrame) -> DataFrame:
    """Runs of each application with check counts over the run's documents."""
    per_document = lenient_summary(checks, "document_id")
    counts = ["pass", "fail", "warning", "needs_review"]
    per_run = links.join(per_document, "document_id").groupBy("run_id").agg(*[F.sum(c).alias(c) for c in counts])
    return (
        runs.where(F.col("application_id").isNotNull())
        .join(per_run, "run_id", "left")
        .select("application_id", "run_id", "status", "started_at", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    )


def compare_findings(a: DataFrame, b: DataFrame, pair: Sequence[str]) -> DataFrame:
    """New issues, resolved issues and status changes between two sides.

    Both sides: ``pair`` columns, rule_id, document_key, status. One row per (pair, rule, document, side).
    """
    keys = [*pair, "rule_id", "document_key"]
    left = a.groupBy(*keys).agg(F.max("status").alias("from_status"))
    right = b.groupBy(*keys).agg(F.max("status").alias("to_status"))
    both = left.join(right, keys, "full")
    was = F.col("from_status").isNotNull() & is_issue(F.col("from_status"))
    now = F.col("to_status").isNotNull() & is_issue(F.col("to_status"))
    moved = (
        F.col("from_status").isNotNull()
        & F.col("to_status").isNotNull()
        & (normalise_status(F.col("from_status")) != normalise_status(F.col("to_status")))
    )
    kinds = F.filter(
        F.array(F.when(now & ~was, "new_issue"), F.when(was & ~now, "resolved_issue"), F.when(moved, "status_change")),
        lambda x: x.isNotNull(),
    )
    return both.select(*keys, "from_status", "to_status", F.explode(kinds).alias("kind"))


def multiset_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], signature: Sequence[str]) -> DataFrame:
    """How many copies of each signature side ``b`` has beyond side ``a`` (positive) or lacks (negative)."""
    both = a.select(*keys, *signature, F.lit(-1).alias("step")).unionByName(b.select(*keys, *signature, F.lit(1).alias("step")))
    totals = both.groupBy(*keys, *signature).agg(F.sum("step").alias("extra_copies"))
    return totals.where(F.col("extra_copies") != 0)


def changed_documents(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """File names on both sides whose hash sets or type sets differ, by counting members, not listing them."""
    def members(df: DataFrame, side: int) -> DataFrame:
        parts = F.explode(
            F.array(
                F.struct(F.lit("hash").alias("kind"), F.col("content_hash").alias("member")),
                F.struct(F.lit("type").alias("kind"), F.col("document_type").alias("member")),
            )
        )
        rows = df.select(*keys, F.lower("filename").alias("name"), parts.alias("part"))
        return rows.select(*keys, "name", "part.*", F.lit(side).alias("side")).distinct()

    united = members(a, 1).unionByName(members(b, 2))
    per_member = united.groupBy(*keys, "name", "kind", "member").agg(F.sum("side").alias("sides"))
    per_name = per_member.groupBy(*keys, "name").agg(
        F.max(F.col("sides").isin(1, 3)).alias("in_a"),
        F.max(F.col("sides").isin(2, 3)).alias("in_b"),
        F.count_if((F.col("sides") != 3) & (F.col("kind") == "hash") & F.col("member").isNotNull()).alias("hash_changes"),
        F.count_if((F.col("sides") != 3) & (F.col("kind") == "type") & F.col("member").isNotNull()).alias("type_changes"),
    )
    return per_name.where("in_a AND in_b AND (hash_changes > 0 OR type_changes > 0)").drop("in_a", "in_b")


def usage_totals(calls: DataFrame, prices: DataFrame, default_model: str) -> DataFrame:
    """Each call priced by the first listed model name contained in its own model name.

    Distinct model names are priced once and joined back, so a call never meets the price list itself. A name is cut
    into its character runs of the lengths that keys have, so that containment is an equality.
    """
    names = calls.select("model").distinct()
    listed = prices.select("ord", "key", "input_price", "output_price")
    sizes = listed.agg(F.collect_set(F.length("key"))).scalar()
    low = F.lower("model")
    runs = F.transform(F.sequence(F.lit(1), F.length(low) - F.col("size") + 1), lambda i: F.substring(low, i, F.col("size")))
    sized = names.select("model", F.explode(sizes).alias("size")).where(F.length(low) >= F.col("size"))
    hit = sized.select("model", F.explode(F.array_distinct(runs)).alias("key")).join(listed, "key")
    best = hit.groupBy("model").agg(F.min(F.struct("ord", "input_price", "output_price")).alias("p"))
    fallback = listed.where(F.col("key") == default_model).select(
        F.col("input_price").alias("d_in"), F.col("output_price").alias("d_out")
    )
    default_in, default_out = fallback.select("d_in").scalar(), fallback.select("d_out").scalar()
    priced = names.join(best, "model", "left").select(
        "model",
        F.coalesce("p.input_price", default_in).alias("input_price"),
        F.coalesce("p.output_price", default_out).alias("output_price"),
    )
    cost = F.col("input_tokens") / 1e6 * F.col("input_price") + F.col("output_tokens") / 1e6 * F.col("output_price")
    return calls.join(priced, "model").withColumn("cost_usd", cost).drop("input_price", "output_price")


def cost_summary(costed: DataFrame, budget: float) -> DataFrame:
    """Calls, tokens and cost per operation, with the whole budget next to each row."""
    per_operation = costed.groupBy("operation").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").alias("__cost"),
    )
    total = costed.select(F.sum("cost_usd")).scalar()
    return per_operation.select(
        "operation",
        "calls",
        "input_tokens",
        "output_tokens",
        F.round("__cost", 4).alias("cost_usd"),
        F.round(total, 4).alias("total_cost_usd"),
        F.round(F.greatest(F.lit(0.0), F.lit(budget) - total), 4).alias("remaining_usd"),
    )


def flat_rate_summary(calls: DataFrame, price_per_1k: float, alert_over: float) -> DataFrame:
    tokens = F.col("input_tokens") + F.col("output_tokens")
    agg = calls.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"))
    cost = F.col("tokens") / 1000 * price_per_1k
    return agg.select(
        "calls",
        "tokens",
        F.round(cost, 4).alias("cost_usd"),
        F.round(F.col("tokens") / F.greatest("calls", F.lit(1)), 4).alias("avg_tokens_per_call"),
        F.round(cost / F.greatest("calls", F.lit(1)), 6).alias("avg_cost_per_call"),
        (cost > alert_over).alias("over_alert"),
    )


# ---- review ------------------------------------------------------------------------------------


def review_status(checks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per run: reviewable findings, decisions, pending (may be negative) and the completeness gate."""
    latest_decisions = latest(decisions, ["run_id", "check_id"], [F.col("ts"), F.col("event_id")], ["decision"])
    decided = latest_decisions.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("reviewed"),
        F.count_if(F.col("decision") == "accept").alias("accepted"),
        F.count_if(F.col("decision") == "reject").alias("rejected"),
        F.count_if(F.col("decision") == "need_info").alias("need_info"),
    )
    reviewable = checks.where(F.col("status") == "needs_review").groupBy("run_id").agg(F.count(F.lit(1)).alias("total"))
    joined = reviewable.join(decided, "run_id", "full")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "reviewed", "accepted", "rejected", "need_info")]
    return joined.select("run_id", *counts).select(
        "*", (F.col("total") - F.col("reviewed")).alias("pending"), (F.col("reviewed") >= F.col("total")).alias("can_complete")
    )


def applied_overrides(checks: DataFrame, overrides: DataFrame) -> DataFrame:
    """Checks with the status shown to users: the latest valid override, else the original."""
    valid = overrides.where(F.col("override_status").isin(*STATUSES))
    newest = latest(valid, ["check_id"], [F.col("created_at"), F.col("override_id")], ["override_status", "officer_id"])
    return checks.join(newest, "check_id", "left").withColumn("display_status", F.coalesce("override_status", "status"))


def check_evidence(checks: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence rows of each check through its list of evidence ids; checks without evidence stay.

    ``checks``: check_id, evidence_ids array. ``evidence``: evidence_id and its columns.
    """
    listed = checks.select("check_id", F.posexplode_outer("evidence_ids").alias("pos", "evidence_id"))
    return listed.join(evidence, "evidence_id", "left")


def merge_metadata(stored: Column, update: Column) -> Column:
    """Two string maps as one; the update wins on equal keys."""
    left, right = F.coalesce(stored, F.create_map().cast("map<string,string>")), F.coalesce(update, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)
