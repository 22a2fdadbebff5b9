"""Version lineage: deltas between a submission and its parent, change sets, impacted rules, integrity checks.

All child/parent pairs are compared in one job. Both sides are first reduced to one row per compared
key, then united and grouped, so a comparison costs one shuffle and is combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.functions.codes import HIGH_IMPACT_FIELDS, MEDIUM_IMPACT_FIELDS, impact_score
from casegrid.operators.ordered import latest, number_within
from casegrid.session import cut_lineage


def version_pairs(submissions: DataFrame) -> DataFrame:
    """(submission_id, parent_id) for every submission that names a parent."""
    return submissions.where(F.col("parent_submission_id").isNotNull()).select(
        F.col("id").alias("submission_id"), F.col("parent_submission_id").alias("parent_id")
    )


def _both_sides(pairs: DataFrame, rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of the child and of the parent of each pair, one row per key with old_/new_ values."""
    keyed = rows.withColumnRenamed("submission_id", "__owner")
    new = pairs.join(keyed, pairs.submission_id == keyed["__owner"]).select(
        "submission_id", *keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(1).alias("in_new")
    )
    # only the parent's rows change place: rows dealt by submission stay where they are on the child's side
    old = pairs.join(keyed, pairs.parent_id == keyed["__owner"]).select(
        "submission_id", *keys, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(1).alias("in_old")
    ).repartition("submission_id")
    names = [f"{side}_{v}" for side in ("new", "old") for v in values]
    return (
        new.unionByName(old, allowMissingColumns=True)
        .groupBy("submission_id", *keys)
        .agg(*[F.max(n).alias(n) for n in names], F.max("in_new").alias("in_new"), F.max("in_old").alias("in_old"))
    )


def _action(old: Column, new: Column) -> Column:
    return F.when(old.isNull(), "added").when(new.isNull(), "removed").otherwise("modified")


def _items(df: DataFrame, kind: str, **cols: Column) -> DataFrame:
    empty = F.lit(None).cast("string")
    order = ["field_key", "document_type", "old_value", "new_value", "action"]
    return df.select("submission_id", F.lit(kind).alias("change_type"), *[cols.get(c, empty).alias(c) for c in order])


def canonical_fields(fields: DataFrame) -> DataFrame:
    """One value per (submission, field): the last one written."""
    return latest(fields, ["submission_id", "field_name"], [F.col("created_at"), F.col("document_id")], ["field_value"])


def field_deltas(pairs: DataFrame, fields: DataFrame) -> DataFrame:
    both = _both_sides(pairs, canonical_fields(fields), ["field_name"], ["field_value"])
    changed = both.where(~F.col("old_field_value").eqNullSafe(F.col("new_field_value")))
    return _items(
        changed,
        "field_delta",
        field_key=F.col("field_name"),
        old_value=F.col("old_field_value"),
        new_value=F.col("new_field_value"),
        action=_action(F.col("old_field_value"), F.col("new_field_value")),
    )


def document_deltas(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """Added and removed hashes, plus a `replaced` row for each type whose hash sets differ.

    Hash sets are compared by counting members per side and in common, never by collecting them.
    """
    hashed = documents.where(F.col("content_hash").isNotNull())
    by_hash = latest(hashed, ["submission_id", "content_hash"], [F.col("document_id")], ["filename", "document_type"])
    both = _both_sides(pairs, by_hash, ["content_hash"], ["filename", "document_type"])
    one_sided = both.where(F.col("in_new").isNull() | F.col("in_old").isNull())
    moved = _items(
        one_sided,
        "document_delta",
        document_type=F.coalesce("new_document_type", "old_document_type"),
        old_value=F.col("old_filename"),
        new_value=F.col("new_filename"),
        action=F.when(F.col("in_old").isNull(), "added").otherwise("removed"),
    )
    typed = documents.where(F.col("document_type").isNotNull())
    members = typed.groupBy("submission_id", "document_type", "content_hash").agg(F.lit(1).alias("member"))
    sets = (
        _both_sides(pairs, members, ["document_type", "content_hash"], ["member"])
        .groupBy("submission_id", "document_type")
        .agg(
            F.max("in_new").alias("in_new"),
            F.max("in_old").alias("in_old"),
            F.count_if(F.col("in_new").isNotNull() & F.col("content_hash").isNotNull()).alias("n_new"),
            F.count_if(F.col("in_old").isNotNull() & F.col("content_hash").isNotNull()).alias("n_old"),
            F.count_if(
                F.col("in_new").isNotNull() & F.col("in_old").isNotNull() & F.col("content_hash").isNotNull()
            ).alias("n_common"),
        )
        .where("in_new = 1 AND in_old = 1 AND (n_common < n_new OR n_common < n_old)")
    )
    replaced = _items(
        sets,
        "document_delta",
        document_type=F.col("document_type"),
        old_value=F.concat("n_old", F.lit(" document(s)")),
        new_value=F.concat("n_new", F.lit(" document(s)")),
        action=F.lit("replaced"),
    )
    return moved.unionByName(replaced)


def spatial_metrics(features: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metrics with their submission and the compared key `type_metric`."""
    return features.join(metrics, "feature_id").withColumn(
        "metric_key", F.concat_ws("_", "feature_type", "metric_name")
    )


def spatial_deltas(pairs: DataFrame, features: DataFrame, metrics: DataFrame) -> DataFrame:
    last = latest(
        spatial_metrics(features, metrics), ["submission_id", "metric_key"], [F.col("feature_id")], ["metric_value"]
    )
    both = _both_sides(pairs, last, ["metric_key"], ["metric_value"])
    old, new = F.col("old_metric_value").cast("string"), F.col("new_metric_value").cast("string")
    changed = both.where(~F.col("old_metric_value").eqNullSafe(F.col("new_metric_value")))
    return _items(
        changed, "spatial_metric_delta", field_key=F.col("metric_key"), old_value=old, new_value=new, action=_action(old, new)
    )


def change_items(pairs: DataFrame, fields: DataFrame, documents: DataFrame, features: DataFrame, metrics: DataFrame) -> DataFrame:
    return (
        field_deltas(pairs, fields)
        .unionByName(document_deltas(pairs, documents))
        .unionByName(spatial_deltas(pairs, features, metrics))
    )


def item_score() -> Column:
    kind, action = F.col("change_type"), F.col("action")
    return (
        F.when(
            kind == "field_delta",
            F.when(F.col("field_key").isin(HIGH_IMPACT_FIELDS), 0.9)
            .when(F.col("field_key").isin(MEDIUM_IMPACT_FIELDS), 0.5)
            .otherwise(0.2),
        )
        .when((kind == "document_delta") & (action == "replaced"), 0.6)
        .when((kind == "document_delta") & action.isin("added", "removed"), 0.4)
        .when(kind == "spatial_metric_delta", 0.7)
    )


def requires_validation(significance: Column) -> Column:
    return F.when(significance > 0.3, "yes").when(significance > 0.1, "partial").otherwise("no")


def change_sets(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per pair: its significance is the highest item score, 0.0 without items."""
    scored = items.groupBy("submission_id").agg(
        F.max(item_score()).alias("score"),
        F.count(F.lit(1)).alias("item_count"),
        F.count_if(F.col("change_type") == "field_delta").alias("field_changes"),
        F.count_if(F.col("change_type") == "document_delta").alias("document_changes"),
        F.count_if(F.col("change_type") == "spatial_metric_delta").alias("spatial_changes"),
    )
    counts = ["item_count", "field_changes", "document_changes", "spatial_changes"]
    significance = F.coalesce("score", F.lit(0.0))
    return pairs.join(scored, "submission_id", "left").select(
        "submission_id",
        "parent_id",
        significance.alias("significance_score"),
        requires_validation(significance).alias("requires_validation"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
    )


def impacted_rules(items: DataFrame, rules: DataFrame, include_documents: bool = False) -> DataFrame:
    """Active rules that require a changed field, per submission (``include_documents`` adds changed types)."""
    changed = items.where((F.col("change_type") == "field_delta") & F.col("field_key").isNotNull()).select(
        "submission_id", F.col("field_key").alias("name")
    )
    if include_documents:
        types = items.where((F.col("change_type") == "document_delta") & F.col("document_type").isNotNull())
        changed = changed.unionByName(types.select("submission_id", F.col("document_type").alias("name")))
    active = rules.where(F.col("is_active")).select("rule_id", F.explode("required_fields").alias("name"))
    return changed.distinct().join(active, "name").select("submission_id", "rule_id").distinct()


def cascade_rules(changes: DataFrame, rules: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rules hit by changed fields at or above an impact threshold, plus everything they trigger.

    ``changes``: (key, field). ``rules``: rule_id, required_fields, dependent_fields map<string,string>
    (field to impact level), triggers_rules. The loop ends when a round adds nothing.
    """
    levels = rules.select("rule_id", F.explode("dependent_fields").alias("field", "level"))
    direct = levels.select("rule_id", "field", impact_score(F.col("level")).alias("score"))
    listed = rules.select("rule_id", F.explode("required_fields").alias("field"), F.lit(0.5).alias("score"))
    legacy = listed.join(levels.select("rule_id", "field"), ["rule_id", "field"], "left_anti")
    seeds = direct.unionByName(legacy).where(F.col("score") >= threshold)
    reached = changes.join(seeds, "field").select("key", "rule_id").distinct().withColumn("round", F.lit(0))
    triggers = rules.select("rule_id", F.explode("triggers_rules").alias("next"))
    if triggers.isEmpty():
        return reached.select("key", "rule_id")
    reached = cut_lineage(reached)
    step = 0
    while True:  # every round adds a rule, so there are no more rounds than rules
        step += 1
        frontier = reached.where(F.col("round") == step - 1)
        found = frontier.join(triggers, "rule_id").select("key", F.col("next").alias("rule_id")).distinct()
        found = cut_lineage(found.join(reached, ["key", "rule_id"], "left_anti").withColumn("round", F.lit(step)))
        if found.isEmpty():
            return reached.select("key", "rule_id")
        reached = cut_lineage(reached.unionByName(found))


def rule_dependencies(rules: DataFrame) -> DataFrame:
    """Each rule with the rules it triggers and the rules that trigger it."""
    back = rules.select(F.col("rule_id").alias("by"), F.explode("triggers_rules").alias("rule_id"))
    back = back.groupBy("rule_id").agg(F.sort_array(F.collect_list("by")).alias("triggered_by_rules"))
    return rules.join(back, "rule_id", "left").select(
        "rule_id",
        "triggers_rules",
        F.coalesce("triggered_by_rules", F.array().cast("array<string>")).alias("triggered_by_rules"),
        "dependent_fields",
        "required_fields",
    )


def dependency_rows(rules: DataFrame) -> DataFrame:
    """One row per rule, direction and other rule; a rule that very many others trigger stays rows."""
    forward = rules.select("rule_id", F.explode("triggers_rules").alias("other")).distinct()
    back = forward.select(F.col("other").alias("rule_id"), F.col("rule_id").alias("other"))
    known = back.join(rules.select("rule_id").distinct(), "rule_id", "left_semi")
    return forward.withColumn("direction", F.lit("triggers")).unionByName(known.withColumn("direction", F.lit("triggered_by")))


# ---- integrity -------------------------------------------------------------------------------


def parent_integrity(submissions: DataFrame) -> DataFrame:
    """Submissions whose parent is missing or belongs to another application."""
    parent = submissions.select(F.col("id").alias("parent_submission_id"), F.col("application_id").alias("parent_application"))
    joined = submissions.where(F.col("parent_submission_id").isNotNull()).join(parent, "parent_submission_id", "left")
    problem = F.when(F.col("parent_application").isNull(), "orphan").when(
        F.col("parent_application") != F.col("application_id"), "cross_application"
    )
    return joined.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(
        "id", "application_id", "parent_submission_id", "problem"
    )


def repair_orphans(submissions: DataFrame) -> DataFrame:
    """New snapshot with the parent of orphans set to NULL."""
    known = submissions.select(F.col("id").alias("parent_submission_id"), F.lit(True).alias("__known"))
    joined = submissions.join(known, "parent_submission_id", "left")
    kept = F.when(F.col("__known"), F.col("parent_submission_id")).alias("parent_submission_id")
    return joined.select(*[kept if c == "parent_submission_id" else F.col(c) for c in submissions.columns])


def version_sequence(submissions: DataFrame) -> DataFrame:
    """Submissions whose version label is not V0..Vn in order of creation."""
    numbered = number_within(
        submissions, ["application_id"], ["created_at", "id"], F.date_trunc("month", "created_at"), number="__n"
    )
    expected = F.concat(F.lit("V"), F.col("__n") - 1)
    return numbered.withColumn("expected_version", expected).where(
        F.col("submission_version") != F.col("expected_version")
    ).select("application_id", "id", "submission_version", "expected_version")


def changeset_mismatch(submissions: DataFrame, sets: DataFrame) -> DataFrame:
    """Change sets whose parent differs from the parent named by their submission."""
    named = submissions.select(F.col("id").alias("submission_id"), "parent_submission_id")
    return sets.join(named, "submission_id").where(
        ~F.col("parent_id").eqNullSafe(F.col("parent_submission_id"))
    ).select("submission_id", "parent_id", "parent_submission_id")


def next_version(version: Column) -> Column:
    return F.concat(F.lit("V"), F.substring(version, 2, 10).cast("int") + 1)


def modification_eligibility(submissions: DataFrame, documents: DataFrame) -> DataFrame:
    """Whether the delta workflow starts for a submission and, if not, why; a broken parent asks for review."""
    owned = documents.groupBy(F.col("submission_id").alias("id")).agg(F.count(F.lit(1)).alias("n_documents"))
    parents = submissions.select(F.col("id").alias("parent_submission_id"), F.lit(True).alias("__parent"))
    reason = (
        F.when(F.col("submission_version") == "V0", "not_a_modification")
        .when(F.col("parent_submission_id").isNull(), "no_parent")
        .when(F.col("__parent").isNull(), "parent_not_found")
        .when(F.coalesce("n_documents", F.lit(0)) == 0, "no_documents")
        .otherwise("eligible")
    )
    status = F.when(reason.isin("no_parent", "parent_not_found"), "needs_review").otherwise(F.col("status"))
    return (
        submissions.join(parents, "parent_submission_id", "left")
        .join(owned, "id", "left")
        .select("id", "submission_version", reason.alias("reason"), status.alias("status"))
    )
