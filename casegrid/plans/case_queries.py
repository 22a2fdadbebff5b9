"""Search, list, dashboard, field and review queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.functions import codes
from casegrid.operators import reports as R
from casegrid.operators import versions as V
from casegrid.operators.ordered import latest, top_per_key
from casegrid.plans.bridge import Tables
from casegrid.plans.registry import query
from casegrid.session import cut_lineage

_CASE_CHANGES = """
 latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY created_at DESC, id DESC) AS rn FROM submissions) WHERE rn = 1),
 checks AS (SELECT submission_id, count(*) FILTER (status = 'fail') AS f, count(*) FILTER (status = 'needs_review') AS r FROM case_checks GROUP BY 1)
"""

# Shared by the version queries: change items stated as SQL.
CHANGE_ITEMS_SQL = """
 pairs AS (SELECT id AS submission_id, parent_submission_id AS parent_id FROM submissions WHERE parent_submission_id IS NOT NULL),
 canon AS (SELECT submission_id, field_name, field_value FROM (SELECT *, row_number() OVER (PARTITION BY submission_id, field_name ORDER BY created_at DESC, document_id DESC) AS rn FROM case_fields) WHERE rn = 1),
 fnew AS (SELECT p.submission_id, c.field_name, c.field_value FROM pairs p JOIN canon c ON c.submission_id = p.submission_id),
 fold AS (SELECT p.submission_id, c.field_name, c.field_value FROM pairs p JOIN canon c ON c.submission_id = p.parent_id),
 fdelta AS (SELECT coalesce(n.submission_id, o.submission_id) AS submission_id, 'field_delta' AS change_type,
   coalesce(n.field_name, o.field_name) AS field_key, CAST(NULL AS VARCHAR) AS document_type, o.field_value AS old_value, n.field_value AS new_value,
   CASE WHEN o.field_value IS NULL THEN 'added' WHEN n.field_value IS NULL THEN 'removed' ELSE 'modified' END AS action
   FROM fnew n FULL JOIN fold o ON n.submission_id = o.submission_id AND n.field_name = o.field_name
   WHERE n.field_value IS DISTINCT FROM o.field_value),
 dh AS (SELECT submission_id, content_hash, max(document_id) AS d FROM case_documents GROUP BY 1, 2),
 dd AS (SELECT h.submission_id, h.content_hash, c.filename, c.document_type FROM dh h JOIN case_documents c ON c.document_id = h.d),
 dnew AS (SELECT p.submission_id, d.content_hash, d.filename, d.document_type FROM pairs p JOIN dd d ON d.submission_id = p.submission_id),
 dold AS (SELECT p.submission_id, d.content_hash, d.filename, d.document_type FROM pairs p JOIN dd d ON d.submission_id = p.parent_id),
 dmoved AS (
   SELECT submission_id, 'document_delta', CAST(NULL AS VARCHAR), document_type, CAST(NULL AS VARCHAR), filename, 'added' FROM dnew n
     WHERE NOT EXISTS (SELECT 1 FROM dold o WHERE o.submission_id = n.submission_id AND o.content_hash = n.content_hash)
   UNION ALL
   SELECT submission_id, 'document_delta', CAST(NULL AS VARCHAR), document_type, filename, CAST(NULL AS VARCHAR), 'removed' FROM dold o
     WHERE NOT EXISTS (SELECT 1 FROM dnew n WHERE o.submission_id = n.submission_id AND o.content_hash = n.content_hash)),
 sets AS (SELECT submission_id, document_type, list_sort(list(DISTINCT content_hash)) AS hs FROM case_documents GROUP BY 1, 2),
 dreplaced AS (SELECT p.submission_id, 'document_delta', CAST(NULL AS VARCHAR), n.document_type, concat(len(o.hs), ' document(s)'), concat(len(n.hs), ' document(s)'), 'replaced'
   FROM pairs p JOIN sets n ON n.submission_id = p.submission_id JOIN sets o ON o.submission_id = p.parent_id AND o.document_type = n.document_type WHERE n.hs <> o.hs),
 sm AS (SELECT submission_id, concat(feature_type, '_', metric_name) AS k, arg_max(metric_value, feature_id) AS v
   FROM case_features JOIN case_metrics USING (feature_id) GROUP BY 1, 2),
 snew AS (SELECT p.submission_id, k, v FROM pairs p JOIN sm ON sm.submission_id = p.submission_id),
 sold AS (SELECT p.submission_id, k, v FROM pairs p JOIN sm ON sm.submission_id = p.parent_id),
 sdelta AS (SELECT coalesce(n.submission_id, o.submission_id), 'spatial_metric_delta', coalesce(n.k, o.k), CAST(NULL AS VARCHAR), CAST(o.v AS VARCHAR), CAST(n.v AS VARCHAR),
   CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' ELSE 'modified' END
   FROM snew n FULL JOIN sold o ON n.submission_id = o.submission_id AND n.k = o.k WHERE n.v IS DISTINCT FROM o.v),
 items AS MATERIALIZED (SELECT * FROM fdelta UNION ALL SELECT * FROM dmoved UNION ALL SELECT * FROM dreplaced UNION ALL SELECT * FROM sdelta),
 scored AS (SELECT submission_id, max(CASE change_type WHEN 'field_delta' THEN
     CASE WHEN field_key IN ('site_address','proposed_use','building_height','floor_area','num_storeys','application_type') THEN 0.9
          WHEN field_key IN ('postcode','applicant_name','agent_name','description') THEN 0.5 ELSE 0.2 END
   WHEN 'document_delta' THEN CASE WHEN action = 'replaced' THEN 0.6 ELSE 0.4 END ELSE 0.7 END) AS score,
   count(*) AS n, count(*) FILTER (change_type = 'field_delta') AS nf, count(*) FILTER (change_type = 'document_delta') AS nd,
   count(*) FILTER (change_type = 'spatial_metric_delta') AS ns FROM items GROUP BY 1),
 change_sets AS (SELECT p.submission_id, p.parent_id, CAST(coalesce(score, 0) AS DOUBLE) AS significance_score,
   CASE WHEN coalesce(score, 0) > 0.3 THEN 'yes' WHEN coalesce(score, 0) > 0.1 THEN 'partial' ELSE 'no' END AS requires_validation,
   coalesce(n, 0) AS item_count, coalesce(nf, 0) AS field_changes, coalesce(nd, 0) AS document_changes, coalesce(ns, 0) AS spatial_changes
   FROM pairs p LEFT JOIN scored USING (submission_id))
"""


def _pairs(t: Tables) -> DataFrame:
    """All version pairs, written once: every kind of change reads them, and numbering versions is a job of its own."""
    if not hasattr(t, "written_pairs"):
        t.written_pairs = cut_lineage(V.version_pairs(t.submissions))
    return t.written_pairs


def all_items(t: Tables) -> DataFrame:
    return V.change_items(_pairs(t), t.by_submission.fields, t.by_submission.documents, t.features, t.metrics)


def all_change_sets(t: Tables) -> DataFrame:
    return V.change_sets(_pairs(t), all_items(t))


@query(
    "G14 J1 J2 W1 G1 D21 X6",
    f"""WITH {CHANGE_ITEMS_SQL}, {_CASE_CHANGES},
    lastrun AS (SELECT application_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY started_at DESC, run_id DESC) AS rn FROM case_runs WHERE application_id IS NOT NULL) WHERE rn = 1)
    SELECT a.id AS application_id, concat(a.application_ref, '-', l.submission_version) AS display_ref,
      CASE WHEN p.id IS NOT NULL THEN concat(a.application_ref, '-', p.submission_version) END AS parent_ref,
      coalesce(a.applicant_name, 'Unknown') AS applicant,
      CASE WHEN l.status <> 'completed' THEN 'Processing' WHEN coalesce(c.f, 0) > 0 THEN 'Issues Found' WHEN coalesce(c.r, 0) > 0 THEN 'In Review' ELSE 'Complete' END AS status,
      strftime(l.created_at, '%Y-%m-%d') AS submitted_on, strftime(a.created_at, '%Y-%m-%d') AS original_date,
      coalesce(c.f, 0) AS issues, coalesce(c.r, 0) AS warnings, p.id IS NOT NULL AS is_modification,
      CASE WHEN p.id IS NOT NULL THEN coalesce(s.field_changes, 0) ELSE 0 END AS field_changes,
      CASE WHEN p.id IS NOT NULL THEN coalesce(s.document_changes, 0) ELSE 0 END AS document_changes,
      l.id AS submission_id, r.run_id
    FROM latest l JOIN applications a ON a.id = l.application_id LEFT JOIN checks c ON c.submission_id = l.id
    LEFT JOIN submissions p ON p.id = l.parent_submission_id LEFT JOIN change_sets s ON s.submission_id = l.id
    LEFT JOIN lastrun r ON r.application_id = a.id""",
)
def case_list(t: Tables) -> DataFrame:
    """Change sets are computed for the latest submissions only, as the list shows no others."""
    newest = R.latest_submissions(t.submissions).select("submission_id", F.col("parent_submission_id").alias("parent_id"))
    pairs = cut_lineage(newest.where(F.col("parent_id").isNotNull()))
    changes = V.change_sets(pairs, V.change_items(pairs, t.by_submission.fields, t.by_submission.documents, t.features, t.metrics))
    return R.case_list(t.applications, t.submissions, t.checks, changes, t.runs)


@query(
    "F1 F2 F3 T1 T2 J1 G1 W1",
    """WITH hit AS (SELECT * FROM applications WHERE (application_ref ILIKE '%7%' OR applicant_name ILIKE '%7%') AND application_type = 'householder'
        AND created_at >= TIMESTAMP '2023-02-01' AND created_at <= TIMESTAMP '2023-11-30'),
    shown AS (SELECT * FROM hit ORDER BY id LIMIT 20 OFFSET 20),
    latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY created_at DESC, id DESC) AS rn FROM submissions) WHERE rn = 1)
    SELECT s.id AS application_id, s.application_ref, s.applicant_name, s.created_at, l.id AS submission_id, l.submission_version,
      (SELECT count(*) FROM case_checks c WHERE c.submission_id = l.id AND status = 'pass') AS pass_count,
      (SELECT count(*) FROM case_checks c WHERE c.submission_id = l.id AND status = 'fail') AS fail_count,
      (SELECT count(*) FROM case_checks c WHERE c.submission_id = l.id AND status = 'needs_review') AS needs_review_count,
      (SELECT count(*) FROM case_checks c WHERE c.submission_id = l.id) AS check_count,
      (SELECT count(*) FROM hit) AS total_count
    FROM shown s LEFT JOIN latest l ON l.application_id = s.id""",
)
def search_applications(t: Tables) -> DataFrame:
    import datetime as dt

    return R.search_applications(
        t.applications,
        t.submissions,
        t.checks,
        text="7",
        filters={"application_type": "householder"},
        date_from=dt.datetime(2023, 2, 1),
        date_to=dt.datetime(2023, 11, 30),
        number=2,
        size=20,
    )


@query(
    "F1 F2 J1 T1 T3 G1",
    """WITH hit AS (SELECT s.*, a.application_ref, a.applicant_name FROM submissions s JOIN applications a ON a.id = s.application_id
      WHERE (a.application_ref ILIKE '%v1%' OR a.applicant_name ILIKE '%v1%' OR s.submission_version ILIKE '%v1%') AND s.status = 'completed'),
    shown AS (SELECT * FROM hit ORDER BY created_at DESC, id DESC LIMIT 50),
    c AS (SELECT submission_id, count(*) FILTER (status = 'pass') AS p, count(*) FILTER (status = 'fail') AS f,
        count(*) FILTER (status = 'needs_review') AS r, count(*) AS n FROM case_checks GROUP BY 1)
    SELECT s.id AS submission_id, application_ref, submission_version, status, created_at, coalesce(p, 0) AS pass_count,
      coalesce(f, 0) AS fail_count, coalesce(r, 0) AS needs_review_count, coalesce(n, 0) AS check_count, (SELECT count(*) FROM hit) AS total_count
    FROM shown s LEFT JOIN c ON c.submission_id = s.id""",
)
def search_submissions(t: Tables) -> DataFrame:
    return R.search_submissions(t.submissions, t.applications, t.checks, text="v1", filters={"status": "completed"})


@query(
    "F1 F2 T3 S17",
    r"""SELECT document_id, filename, document_type, regexp_extract(blob_uri, '^azure://[^/]*/([^/]*)/(.+)$', 1) AS container,
      regexp_extract(blob_uri, '^azure://[^/]*/([^/]*)/(.+)$', 2) AS blob_path
    FROM case_documents WHERE filename ILIKE '%plan\_1%' ESCAPE '\' AND document_type = 'site_plan'""",
)
def search_documents(t: Tables) -> DataFrame:
    from casegrid.sources.layout import blob_location

    hit = t.documents.where(R.ilike_any("plan_1", "filename") & R.equal_to({"document_type": "site_plan"}))
    return blob_location(hit, "blob_uri").select("document_id", "filename", "document_type", "container", "blob_path")


@query(
    "F27 F13 J3 X35 G45 F10",
    """SELECT r.run_id, a.application_ref, r.status, CAST(coalesce(json_extract_string(run_metadata, '$.progress.current'), '0') AS BIGINT) AS progress_current,
      CAST(coalesce(json_extract_string(run_metadata, '$.progress.total'), '0') AS BIGINT) AS progress_total,
      CAST(json_extract_string(run_metadata, '$.summary.failures') AS BIGINT) AS failures,
      CAST(epoch_ms(completed_at) - epoch_ms(started_at) AS BIGINT) AS processing_ms
    FROM case_runs r LEFT JOIN applications a ON a.id = r.application_id""",
)
def run_progress(t: Tables) -> DataFrame:
    apps = t.applications.select(F.col("id").alias("application_id"), "application_ref")

    def number(path: str):
        return F.get_json_object("run_metadata", path).cast("long")

    return t.runs.join(apps, "application_id", "left").select(
        "run_id",
        "application_ref",
        "status",
        F.coalesce(number("$.progress.current"), F.lit(0)).alias("progress_current"),
        F.coalesce(number("$.progress.total"), F.lit(0)).alias("progress_total"),
        number("$.summary.failures").alias("failures"),
        (F.unix_millis("completed_at") - F.unix_millis("started_at")).alias("processing_ms"),
    )


@query(
    "F4 F3 G45",
    """SELECT preset, status, count(*) AS runs FROM (
      SELECT 'today' AS preset, status FROM case_runs WHERE started_at >= TIMESTAMP '1998-06-15'
      UNION ALL SELECT 'last_7_days', status FROM case_runs WHERE started_at >= TIMESTAMP '1998-06-15 12:00:00' - INTERVAL 7 DAY
      UNION ALL SELECT 'last_30_days', status FROM case_runs WHERE started_at >= TIMESTAMP '1998-06-15 12:00:00' - INTERVAL 30 DAY
      UNION ALL SELECT 'custom', status FROM case_runs WHERE started_at >= TIMESTAMP '1997-01-01' AND started_at < TIMESTAMP '1997-02-01'
      UNION ALL SELECT 'all', status FROM case_runs) GROUP BY 1, 2""",
)
def runs_by_preset(t: Tables) -> DataFrame:
    """One scan: each run is tagged with every preset it falls into, then counted."""
    as_of = F.lit("1998-06-15 12:00:00").cast("timestamp")
    presets = ["all", "today", "last_7_days", "last_30_days", "custom"]
    tags = [F.when(R.preset_range("started_at", p, as_of, "1997-01-01", "1997-01-31"), F.lit(p)) for p in presets]
    tagged = t.runs.select("status", F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())).alias("preset"))
    return tagged.groupBy("preset", "status").agg(F.count(F.lit(1)).alias("runs"))


@query(
    "G4 G7 F3 G45",
    """WITH k AS (SELECT (SELECT count(*) FROM applications) AS c, count(*) AS s, count(*) FILTER (submission_version <> 'V0') AS m,
      count(*) FILTER (parent_submission_id IS NOT NULL) AS rv FROM submissions),
    v AS (SELECT count(*) FILTER (status = 'pass') AS p, count(*) FILTER (status = 'fail') AS f, count(*) FILTER (status = 'needs_review') AS r FROM case_checks)
    SELECT c AS total_cases, s AS total_submissions, rv AS revisions, p + f + r AS total_checks, p AS pass_count, f AS fail_count, r AS needs_review_count,
      round(p / (p + f + r) * 100, 4) AS pass_rate, round((p + f + r) / s, 4) AS avg_checks_per_submission,
      round(s / c, 4) AS avg_submissions_per_case, round(m / s * 100, 4) AS modification_rate FROM k, v""",
)
def dashboard_headline(t: Tables) -> DataFrame:
    return R.headline(t.applications, t.submissions, t.checks)


@query(
    "G5 T3",
    """SELECT rule_id, count(*) AS fail_count FROM case_checks WHERE status = 'fail' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def top_failing_rules(t: Tables) -> DataFrame:
    return R.top_failing_rules(t.checks)


@query(
    "G6 G8 F6 G22",
    """SELECT application_type, status, count(*) AS cases, CAST(floor(count(*) / (SELECT count(*) FROM applications) * 100) AS INTEGER) AS share_pct,
      count(*) FILTER (applicant_name IS NULL) AS unnamed FROM applications GROUP BY 1, 2""",
)
def case_status_distribution(t: Tables) -> DataFrame:
    total = t.applications.select(F.count(F.lit(1))).scalar()
    return (
        t.applications.groupBy("application_type", "status")
        .agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("applicant_name").isNull()).alias("unnamed"))
        .withColumn("share_pct", F.floor(F.col("cases") / F.greatest(total, F.lit(1)) * 100).cast("int"))
    )


@query(
    "G9 D23 F26",
    """WITH o AS (SELECT event_id, concat('c', check_no) AS check_id, CASE WHEN run_id % 10 = 0 THEN NULL ELSE concat('officer-', run_id % 50) END AS officer FROM review_events WHERE decision <> 'need_info')
    SELECT coalesce(officer, 'Unknown') AS officer, count(*) AS override_count, (SELECT count(DISTINCT officer) FROM o) AS active_officers FROM o GROUP BY 1""",
)
def override_statistics(t: Tables) -> DataFrame:
    overrides = _overrides(t)
    officers = overrides.select(F.count_distinct("officer_id")).scalar()
    return R.override_statistics(overrides).withColumn("active_officers", officers)


def _overrides(t: Tables) -> DataFrame:
    return t.decisions.where(F.col("decision") != "need_info").select(
        F.col("event_id").alias("override_id"),
        F.concat(F.lit("c"), "check_no").alias("check_id"),
        F.when(F.col("run_id") % 10 != 0, F.concat(F.lit("officer-"), F.col("run_id") % 50)).alias("officer_id"),
        F.when(F.col("decision") == "accept", "pass").otherwise("fail").alias("override_status"),
        F.col("ts").alias("created_at"),
    )


@query(
    "D23 F26 W1",
    """WITH o AS (SELECT event_id, check_no, CASE decision WHEN 'accept' THEN 'pass' ELSE 'fail' END AS override_status, ts FROM review_events WHERE decision <> 'need_info'),
    lo AS (SELECT check_no, override_status FROM (SELECT *, row_number() OVER (PARTITION BY check_no ORDER BY ts DESC, event_id DESC) AS rn FROM o) WHERE rn = 1),
    c AS (SELECT *, CAST(split_part(check_id, '-', 3) AS BIGINT) AS check_no FROM case_checks)
    SELECT c.rule_id, c.severity, c.status AS original_status, coalesce(lo.override_status, c.status) AS display_status, count(*) AS findings
    FROM c LEFT JOIN lo ON lo.check_no = c.check_no GROUP BY 1, 2, 3, 4""",
)
def display_status_counts(t: Tables) -> DataFrame:
    checks = t.checks.withColumn("check_id", F.concat(F.lit("c"), F.split("check_id", "-")[2]))
    shown = R.applied_overrides(checks, _overrides(t))
    return shown.groupBy("rule_id", "severity", F.col("status").alias("original_status"), "display_status").agg(
        F.count(F.lit(1)).alias("findings")
    )


@query(
    "G11 G10",
    """WITH d AS (SELECT content_hash, count(*) AS copies FROM case_documents GROUP BY 1 HAVING count(*) > 1)
    SELECT content_hash, copies, document_id, filename FROM case_documents JOIN d USING (content_hash)""",
)
def duplicate_hashes(t: Tables) -> DataFrame:
    return R.duplicate_hashes(t.documents)


@query(
    "D17 S7",
    """SELECT document_id, submission_id, first_value(document_id) OVER w AS kept_document_id, document_id <> first_value(document_id) OVER w AS is_duplicate
    FROM case_documents WINDOW w AS (PARTITION BY content_hash ORDER BY uploaded_at, document_id)""",
)
def ingest_duplicates(t: Tables) -> DataFrame:
    return R.ingest_duplicates(t.documents)


@query(
    "G10 J2 G12",
    """SELECT a.id AS application_id, count(DISTINCT s.id) AS submissions, count(d.document_id) AS documents, coalesce(sum(d.page_count), 0)::BIGINT AS pages
    FROM applications a LEFT JOIN submissions s ON s.application_id = a.id LEFT JOIN case_documents d ON d.submission_id = s.id GROUP BY 1""",
)
def documents_per_application(t: Tables) -> DataFrame:
    per_submission = t.documents.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("page_count").alias("pages")
    )
    owned = (
        t.submissions.select(F.col("id").alias("submission_id"), "application_id")
        .join(per_submission, "submission_id", "left")
        .groupBy("application_id")
        .agg(F.count(F.lit(1)).alias("submissions"), F.sum("documents").alias("documents"), F.sum("pages").alias("pages"))
    )
    apps = t.applications.select(F.col("id").alias("application_id"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("submissions", "documents", "pages")]
    return apps.join(owned, "application_id", "left").select("application_id", *counts)


@query(
    "J8 G2 G13 G44",
    """WITH d AS (SELECT DISTINCT run_id, document_id FROM case_run_documents UNION ALL
        SELECT run_id, document_id FROM case_runs r WHERE NOT EXISTS (SELECT 1 FROM case_run_documents b WHERE b.run_id = r.run_id))
    SELECT r.application_id, r.run_id, r.status, r.started_at, count(c.check_id) FILTER (c.status = 'pass') AS pass, count(c.check_id) FILTER (c.status = 'fail') AS fail,
      count(c.check_id) FILTER (c.status = 'warning') AS warning, count(c.check_id) FILTER (c.status = 'needs_review') AS needs_review
    FROM case_runs r LEFT JOIN d ON d.run_id = r.run_id LEFT JOIN case_checks c ON c.document_id = d.document_id
    WHERE r.application_id IS NOT NULL GROUP BY 1, 2, 3, 4""",
)
def run_history(t: Tables) -> DataFrame:
    return R.run_history(t.runs, R.run_documents(t.runs, t.run_documents), t.checks)


@query(
    "J28 F13 D32 D33",
    """SELECT r.run_id, a.id AS linked_application_id, CASE WHEN json_extract_string(run_metadata, '$.application_ref') IS NULL THEN 'no_reference'
      WHEN a.id IS NULL THEN 'unknown_reference' ELSE 'linked' END AS outcome
    FROM case_runs r LEFT JOIN applications a ON a.application_ref = json_extract_string(run_metadata, '$.application_ref') WHERE r.application_id IS NULL""",
)
def repair_run_links(t: Tables) -> DataFrame:
    open_runs = t.runs.where(F.col("application_id").isNull()).select(
        "run_id", F.get_json_object("run_metadata", "$.application_ref").alias("application_ref")
    )
    apps = t.applications.select("application_ref", F.col("id").alias("linked_application_id"))
    outcome = (
        F.when(F.col("application_ref").isNull(), "no_reference")
        .when(F.col("linked_application_id").isNull(), "unknown_reference")
        .otherwise("linked")
    )
    return open_runs.join(apps, "application_ref", "left").select("run_id", "linked_application_id", outcome.alias("outcome"))


@query(
    "D32 D33 F5",
    """SELECT run_id, min(document_id) AS document_id, count(DISTINCT document_id) AS linked FROM (
      SELECT run_id, document_id FROM case_run_documents UNION ALL SELECT run_id, document_id FROM case_runs) GROUP BY 1""",
)
def run_link_backfill(t: Tables) -> DataFrame:
    united = t.run_documents.unionByName(t.runs.select("run_id", "document_id"))
    return united.dropDuplicates(["run_id", "document_id"]).groupBy("run_id").agg(
        F.min("document_id").alias("document_id"), F.count(F.lit(1)).alias("linked")
    )


@query(
    "W2 T7 X21 X23 D19",
    """SELECT submission_id, field_name, field_value, confidence, extractor,
      CASE WHEN field_name = 'application_ref' THEN 'Application Reference' WHEN field_name = 'postcode' THEN 'Postcode' WHEN field_name = 'site_address' THEN 'Site Address'
        WHEN field_name = 'floor_area' THEN 'Floor Area' WHEN field_name = 'ridge_height' THEN 'Ridge Height' ELSE 'Boundary Distance' END AS label,
      CASE WHEN confidence IS NULL THEN 'Unknown' WHEN confidence >= 0.9 THEN 'High' WHEN confidence >= 0.7 THEN 'Medium' WHEN confidence >= 0.5 THEN 'Low' ELSE 'Very Low' END AS confidence_label,
      CASE WHEN field_value IS NULL THEN 'Not provided' WHEN field_unit = 'sqm' THEN concat(field_value, ' square metres') WHEN field_unit = 'm' THEN concat(field_value, ' metres') ELSE field_value END AS formatted_value
    FROM (SELECT *, row_number() OVER (PARTITION BY submission_id, field_name ORDER BY coalesce(confidence, -1) DESC, created_at DESC, document_id DESC) AS rn FROM case_fields) WHERE rn = 1""",
)
def best_fields(t: Tables) -> DataFrame:
    from casegrid.functions.text import field_label, format_scalar

    best = R.best_fields(t.by_submission.fields, "submission_id")
    return best.select(
        "submission_id",
        "field_name",
        "field_value",
        "confidence",
        "extractor",
        field_label(F.col("field_name")).alias("label"),
        codes.confidence_label(F.col("confidence")).alias("confidence_label"),
        format_scalar(F.col("field_value"), F.col("field_unit")).alias("formatted_value"),
    )


@query(
    "G15 F9",
    """SELECT submission_id, field_name, count(DISTINCT coalesce(field_value, chr(0))) AS value_count, count(*) AS entry_count
    FROM case_fields GROUP BY 1, 2 HAVING count(DISTINCT coalesce(field_value, chr(0))) > 1""",
)
def field_conflicts(t: Tables) -> DataFrame:
    from casegrid.operators.rules import field_conflicts as clashes

    return clashes(t.by_submission.fields).select("submission_id", "field_name", "value_count", F.col("entry_count").cast("long").alias("entry_count"))


@query(
    "G16 D24",
    """WITH r AS (SELECT * FROM (SELECT run_id AS submission_id, CASE check_no % 3 WHEN 0 THEN 'postcode' WHEN 1 THEN 'floor_area' ELSE 'site_address' END AS field_name,
        concat('chosen-', check_no) AS chosen_value, concat('officer-', event_id) AS officer_id, ts FROM review_events)
      QUALIFY row_number() OVER (PARTITION BY submission_id, field_name ORDER BY ts DESC, officer_id DESC) = 1)
    SELECT f.submission_id, f.field_name, count(DISTINCT CASE WHEN field_value <> '' THEN field_value END) AS value_count, count(*) AS entry_count,
      count(DISTINCT CASE WHEN field_value <> '' THEN field_value END) > 1 AS has_conflict, any_value(r.chosen_value) AS chosen_value, any_value(r.officer_id) AS officer_id
    FROM case_fields f LEFT JOIN r ON r.submission_id = f.submission_id AND r.field_name = f.field_name GROUP BY 1, 2""",
)
def field_view(t: Tables) -> DataFrame:
    resolutions = t.decisions.select(
        F.col("run_id").alias("submission_id"),
        F.when(F.col("check_no") % 3 == 0, "postcode").when(F.col("check_no") % 3 == 1, "floor_area").otherwise("site_address").alias("field_name"),
        F.concat(F.lit("chosen-"), "check_no").alias("chosen_value"),
        F.concat(F.lit("officer-"), "event_id").alias("officer_id"),
        F.col("ts").alias("created_at"),
    )
    return R.field_view(t.by_submission.fields, resolutions)


@query(
    "G48 V3",
    """WITH k AS (SELECT submission_id, field_name FROM case_fields GROUP BY 1, 2 HAVING count(DISTINCT coalesce(field_value, chr(0))) > 1),
    v AS (SELECT f.* FROM case_fields f JOIN k USING (submission_id, field_name))
    SELECT submission_id, field_name, field_value, count(*) AS occurrences, array_to_string(list_sort(list(document_id ORDER BY document_id)[1:2]), ',') AS first_sources
    FROM v GROUP BY 1, 2, 3""",
)
def conflict_options(t: Tables) -> DataFrame:
    return R.conflict_options(t.by_submission.fields)


@query(
    "D26 W2",
    """WITH answers AS (SELECT run_id AS submission_id, concat('answer-', event_id) AS document_id, 'bng_applicable' AS field_name,
        CASE decision WHEN 'accept' THEN 'true' ELSE 'false' END AS field_value, NULL AS field_unit, 1.0 AS confidence, 'user' AS extractor, ts AS created_at
        FROM review_events WHERE decision <> 'need_info'),
    u AS (SELECT * FROM case_fields UNION ALL SELECT * FROM answers)
    SELECT submission_id, field_name, field_value, extractor FROM u
    QUALIFY row_number() OVER (PARTITION BY submission_id, field_name ORDER BY coalesce(confidence, -1) DESC, created_at DESC, document_id DESC) = 1""",
)
def answers_over_fields(t: Tables) -> DataFrame:
    answers = t.decisions.where(F.col("decision") != "need_info").select(
        F.col("run_id").alias("submission_id"),
        F.concat(F.lit("answer-"), "event_id").alias("document_id"),
        F.lit("bng_applicable").alias("field_name"),
        F.when(F.col("decision") == "accept", "true").otherwise("false").alias("field_value"),
        F.col("ts").alias("created_at"),
    )
    return R.effective_fields(t.by_submission.fields, answers).select("submission_id", "field_name", "field_value", "extractor")


@query(
    "E24",
    """WITH s AS (SELECT submission_id AS key, field_name, field_value, created_at FROM case_fields WHERE field_value <> ''),
    a AS (SELECT DISTINCT f.submission_id AS key, 'applicant' AS field_name, a.applicant_name AS field_value FROM case_fields f JOIN submissions s ON s.id = f.submission_id JOIN applications a ON a.id = s.application_id WHERE a.applicant_name IS NOT NULL)
    SELECT key, field_name, field_value, 1 AS level FROM s QUALIFY row_number() OVER (PARTITION BY key, field_name ORDER BY created_at, field_value DESC) = 1
    UNION ALL SELECT key, field_name, field_value, 0 FROM a""",
)
def resolved_field_merge(t: Tables) -> DataFrame:
    submission_level = t.by_submission.fields.where("field_value <> ''").select(
        F.col("submission_id").alias("key"), "field_name", "field_value", F.col("created_at").alias("resolved_at")
    )
    names = t.applications.where(F.col("applicant_name").isNotNull()).select(F.col("id").alias("application_id"), "applicant_name")
    owners = t.submissions.select(F.col("id").alias("key"), "application_id")
    with_fields = t.by_submission.fields.select(F.col("submission_id").alias("key")).distinct()
    application_level = (
        owners.join(with_fields, "key", "left_semi")
        .join(names, "application_id")
        .select("key", F.lit("applicant").alias("field_name"), F.col("applicant_name").alias("field_value"))
        .withColumn("resolved_at", F.lit("2024-01-01").cast("timestamp"))
    )
    return R.merged_resolved([application_level, submission_level])


@query(
    "D19 D18 J1",
    """WITH f AS (SELECT s.application_id, f.field_value FROM case_fields f JOIN submissions s ON s.id = f.submission_id WHERE f.field_name = 'site_address' AND f.field_value <> ''
      QUALIFY row_number() OVER (PARTITION BY s.application_id ORDER BY coalesce(f.confidence, -1) DESC, f.created_at DESC, f.document_id DESC) = 1)
    SELECT a.id, a.application_ref, coalesce(nullif(a.proposal_description, ''), f.field_value) AS proposal_description FROM applications a LEFT JOIN f ON f.application_id = a.id""",
)
def enriched_applications(t: Tables) -> DataFrame:
    rows = R.enriched_applications(t.applications, t.submissions, t.fields, {"site_address": "proposal_description"})
    return rows.select("id", "application_ref", "proposal_description")


@query(
    "D18",
    """WITH inc AS (SELECT o_custkey + 100 AS id, max(o_orderpriority) AS proposal_description, max(o_orderstatus) AS applicant_name FROM orders GROUP BY 1)
    SELECT coalesce(a.id, i.id) AS id, coalesce(nullif(a.proposal_description, ''), i.proposal_description) AS proposal_description,
      coalesce(nullif(a.applicant_name, ''), i.applicant_name) AS applicant_name FROM applications a FULL JOIN inc i ON i.id = a.id""",
)
def application_upsert(t: Tables) -> DataFrame:
    incoming = (
        t.raw("orders")
        .groupBy((F.col("o_custkey") + 100).alias("id"))
        .agg(F.max("o_orderpriority").alias("proposal_description"), F.max("o_orderstatus").alias("applicant_name"))
    )
    return R.upsert_blanks(t.applications, incoming, "id", ["proposal_description", "applicant_name"])


@query(
    "F25 T4 F28 F11 F10",
    """SELECT a.application_type, CASE WHEN c.status = 'fail' AND c.severity = 'error' THEN 'critical' WHEN c.status = 'fail' THEN 'warning' WHEN c.status = 'needs_review' THEN 'needs_review' ELSE 'info' END AS bucket,
      count(*) AS findings, count(*) FILTER (lower(c.status) NOT IN ('pass', 'passed')) AS issues
    FROM case_checks c JOIN submissions s ON s.id = c.submission_id JOIN applications a ON a.id = s.application_id
    WHERE contains(lower(a.application_ref), 'app/2024/1') OR contains(lower(coalesce(a.applicant_name, '')), '9') GROUP BY 1, 2""",
)
def severity_buckets(t: Tables) -> DataFrame:
    def holds(col: str, text: str):
        return F.lower(F.coalesce(col, F.lit(""))).contains(text.lower())

    apps = t.applications.where(holds("application_ref", "APP/2024/1") | holds("applicant_name", "9"))
    owners = t.submissions.select(F.col("id").alias("submission_id"), "application_id").join(
        apps.select(F.col("id").alias("application_id"), "application_type"), "application_id"
    )
    bucket = (
        F.when((F.col("status") == "fail") & (F.col("severity") == "error"), "critical")
        .when(F.col("status") == "fail", "warning")
        .when(F.col("status") == "needs_review", "needs_review")
        .otherwise("info")
    )
    per_submission = t.checks.groupBy("submission_id", bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(codes.is_issue(F.col("status"))).alias("open")
    )
    return (
        per_submission.join(owners, "submission_id")
        .groupBy("application_type", "bucket")
        .agg(F.sum("n").alias("findings"), F.sum("open").alias("issues"))
    )


@query(
    "J24 G25",
    """WITH c AS (SELECT *, input_tokens / 1e6 * CASE WHEN lower(model) LIKE '%gpt-4o%' THEN 2.5 WHEN lower(model) LIKE '%text-embedding-3-small%' THEN 0.02 WHEN lower(model) LIKE '%text-embedding-3-large%' THEN 0.13 ELSE 2.5 END
      + output_tokens / 1e6 * CASE WHEN lower(model) LIKE '%gpt-4o%' THEN 10.0 WHEN lower(model) LIKE '%text-embedding%' THEN 0.0 ELSE 10.0 END AS cost FROM usage_calls)
    SELECT operation, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost)::DOUBLE, 4) AS cost_usd,
      round((SELECT sum(cost) FROM c)::DOUBLE, 4) AS total_cost_usd, round(greatest(0.0, 10.0 - (SELECT sum(cost) FROM c))::DOUBLE, 4) AS remaining_usd FROM c GROUP BY 1""",
)
def usage_cost(t: Tables) -> DataFrame:
    return R.cost_summary(_costed(t), budget=10.0)


def _costed(t: Tables) -> DataFrame:
    from casegrid.functions.prices import price_table

    return R.usage_totals(t.usage, price_table(t.spark), default_model="gpt-4o")


@query(
    "G26 G24",
    """SELECT count(*) AS calls, sum(input_tokens + output_tokens)::BIGINT AS tokens, round(sum(input_tokens + output_tokens) / 1000 * 0.03, 4) AS cost_usd,
      round(sum(input_tokens + output_tokens) / count(*), 4) AS avg_tokens_per_call, round(sum(input_tokens + output_tokens) / 1000 * 0.03 / count(*), 6) AS avg_cost_per_call,
      sum(input_tokens + output_tokens) / 1000 * 0.03 > 5.0 AS over_alert FROM usage_calls""",
)
def usage_flat_rate(t: Tables) -> DataFrame:
    return R.flat_rate_summary(t.usage, price_per_1k=0.03, alert_over=5.0)


@query(
    "ST6 W13",
    """WITH c AS (SELECT conv_id, turn, input_tokens + output_tokens AS tokens FROM usage_calls),
    r AS (SELECT *, sum(tokens) OVER (ORDER BY conv_id, turn ROWS UNBOUNDED PRECEDING) AS running FROM c)
    SELECT conv_id, turn, CAST(running AS BIGINT) AS running_tokens, running > 100000 AS over_budget, running > 100000 AND running - tokens <= 100000 AS crossing FROM r""",
)
def spend_guard(t: Tables) -> DataFrame:
    """Running spend over all calls: one running sum across the whole table, a range of calls per task."""
    from casegrid.operators.ordered import global_running_sum

    calls = t.usage.select("conv_id", "turn", (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    total = global_running_sum(calls, ["conv_id", "turn"], "tokens", "running_tokens")
    over = F.col("running_tokens") > 100000
    return total.select(
        "conv_id", "turn", "running_tokens", over.alias("over_budget"), (over & (F.col("running_tokens") - F.col("tokens") <= 100000)).alias("crossing")
    )


@query(
    "G19 G20 G21 D25 F28 ST8",
    """WITH d AS (SELECT run_id, check_no, decision FROM review_events QUALIFY row_number() OVER (PARTITION BY run_id, check_no ORDER BY ts DESC, event_id DESC) = 1),
    k AS (SELECT run_id, count(*) AS reviewed, count(*) FILTER (decision = 'accept') AS accepted, count(*) FILTER (decision = 'reject') AS rejected, count(*) FILTER (decision = 'need_info') AS need_info FROM d GROUP BY 1),
    c AS (SELECT submission_id AS run_id, count(*) AS total FROM case_checks WHERE status = 'needs_review' GROUP BY 1)
    SELECT coalesce(c.run_id, k.run_id) AS run_id, coalesce(total, 0) AS total, coalesce(reviewed, 0) AS reviewed, coalesce(accepted, 0) AS accepted, coalesce(rejected, 0) AS rejected,
      coalesce(need_info, 0) AS need_info, coalesce(total, 0) - coalesce(reviewed, 0) AS pending, coalesce(reviewed, 0) >= coalesce(total, 0) AS can_complete FROM c FULL JOIN k ON c.run_id = k.run_id""",
)
def review_status(t: Tables) -> DataFrame:
    checks = t.checks.withColumnRenamed("submission_id", "run_id")
    return R.review_status(checks, t.decisions.withColumnRenamed("check_no", "check_id"))


@query(
    "G3 G23 G42 G44 G47",
    """SELECT severity, status, count(*) AS findings, count(DISTINCT submission_id) AS submissions, count(*) FILTER (status IN ('fail', 'needs_review') AND severity = 'error') AS blocking FROM case_checks GROUP BY 1, 2""",
)
def severity_status_matrix(t: Tables) -> DataFrame:
    per_submission = t.checks.groupBy("severity", "status", "submission_id").agg(F.count(F.lit(1)).alias("n"))
    blocking = F.col("status").isin("fail", "needs_review") & (F.col("severity") == "error")
    return per_submission.groupBy("severity", "status").agg(
        F.sum("n").alias("findings"),
        F.count(F.lit(1)).alias("submissions"),
        F.sum(F.when(blocking, F.col("n")).otherwise(0)).alias("blocking"),
    )


@query(
    "W3 W4 V20 X24 X25 J10 T8",
    """WITH f AS (SELECT c.*, d.filename FROM case_checks c JOIN case_documents d ON d.document_id = c.document_id)
    SELECT f.submission_id, f.rule_id, f.filename AS document_name, f.explanation AS message, min(f.check_id) AS check_id,
      CASE f.explanation WHEN 'Missing required fields: site_address, proposed_use' THEN 'Missing required information: Site Address, Proposed Use' ELSE f.explanation END AS formatted_message,
      CASE f.explanation WHEN 'Missing required fields: site_address, proposed_use' THEN 'Please ensure this information is included in your application documents.'
        WHEN 'Inconsistent postcode' THEN 'Please verify and correct the inconsistent information.' ELSE 'Please review this item and take appropriate action.' END AS action_guidance,
      CASE f.rule_id WHEN 'R1' THEN 'Site Address Validation' WHEN 'R2' THEN 'Proposed Use Validation' WHEN 'R3' THEN 'Application Reference' WHEN 'R4' THEN 'Certificate Validation' WHEN 'R5' THEN 'Fee Payment'
        WHEN 'R-DOC-001' THEN 'Application Form Required' ELSE 'Site Plan Required' END AS title
    FROM f GROUP BY 1, 2, 3, 4""",
)
def formatted_findings(t: Tables) -> DataFrame:
    from casegrid.functions.rule_catalog import builtin_rules
    from casegrid.functions.text import action_guidance, friendly_message

    names = t.documents.select("document_id", F.col("filename").alias("document_name"))
    joined = t.checks.join(names, "document_id")
    kept = joined.groupBy("submission_id", "rule_id", "document_name", F.col("explanation").alias("message")).agg(
        F.min("check_id").alias("check_id")
    )
    titles = builtin_rules(t.spark).select("rule_id", "title")
    return kept.join(titles, "rule_id", "left").select(
        "submission_id",
        "rule_id",
        "document_name",
        "message",
        "check_id",
        friendly_message(F.col("message")).alias("formatted_message"),
        action_guidance(F.col("message")).alias("action_guidance"),
        F.coalesce("title", "rule_id").alias("title"),
    )


@query(
    "T3 T4 J1 G45",
    """SELECT s.id AS submission_id, a.application_ref, s.status, s.created_at FROM submissions s JOIN applications a ON a.id = s.application_id ORDER BY s.created_at DESC, s.id DESC LIMIT 10""",
)
def recent_activity(t: Tables) -> DataFrame:
    apps = t.applications.select(F.col("id").alias("application_id"), "application_ref")
    joined = t.submissions.join(apps, "application_id")
    return joined.select(F.col("id").alias("submission_id"), "application_ref", "status", "created_at").orderBy(
        F.desc("created_at"), F.desc("submission_id")
    ).limit(10)


@query(
    "G49 J6 F18 F6",
    """SELECT id AS application_id, EXISTS (SELECT 1 FROM submissions s WHERE s.application_id = a.id) AS has_submission,
      EXISTS (SELECT 1 FROM case_runs r WHERE r.application_id = a.id AND r.status = 'completed') AS has_completed_run FROM applications a""",
)
def availability_matrix(t: Tables) -> DataFrame:
    subs = t.submissions.select("application_id").distinct().withColumn("__s", F.lit(True))
    runs = t.runs.where("status = 'completed' AND application_id IS NOT NULL").select("application_id").distinct().withColumn("__r", F.lit(True))
    apps = t.applications.select(F.col("id").alias("application_id"))
    return (
        apps.join(subs, "application_id", "left")
        .join(runs, "application_id", "left")
        .select("application_id", F.col("__s").isNotNull().alias("has_submission"), F.col("__r").isNotNull().alias("has_completed_run"))
    )


@query(
    "S1 S2 F5 F13",
    """SELECT status, count(*) AS runs, sum(CAST(json_extract_string(run_metadata, '$.summary.successes') AS BIGINT))::BIGINT AS successes FROM case_runs WHERE status IN ('completed', 'failed') GROUP BY 1""",
)
def parametrised_sql(t: Tables) -> DataFrame:
    from casegrid.sources.tables import run_sql

    return run_sql(
        t.spark,
        "SELECT status, count(*) AS runs, sum(cast(get_json_object(run_metadata, '$.summary.successes') AS bigint)) AS successes "
        "FROM {runs} WHERE array_contains(:wanted, status) GROUP BY status",
        {"runs": t.runs},
        {"wanted": F.array(F.lit("completed"), F.lit("failed"))},
    )


@query(
    "F12 D28 X30 F24 D29",
    """WITH e AS (SELECT run_id, event_id, ts, CASE decision WHEN 'need_info' THEN 'request' WHEN 'accept' THEN 'response' END AS kind FROM review_events WHERE decision <> 'reject'),
    l AS (SELECT run_id, max(ts) FILTER (kind = 'request') AS last_request, max(ts) FILTER (kind = 'response') AS last_response, count(*) FILTER (kind = 'request') AS requests, count(*) FILTER (kind = 'response') AS responses FROM e GROUP BY 1)
    SELECT run_id, requests, responses, CASE WHEN last_request IS NOT NULL AND (last_response IS NULL OR last_response < last_request) THEN 'needs_info' ELSE 'in_progress' END AS state,
      strftime(CAST(last_request AS DATE) + 21, '%Y-%m-%d') AS due_on FROM l""",
)
def information_requests(t: Tables) -> DataFrame:
    from casegrid.operators.issues import information_request_state

    events = t.decisions.where("decision <> 'reject'").select(
        "run_id", "ts", F.when(F.col("decision") == "need_info", "request").otherwise("response").alias("kind")
    )
    return information_request_state(events, "run_id")


@query(
    "D30 D31 G46 G23 ST4",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY ts, action_id) AS o FROM issue_actions),
    f AS (SELECT issue_id, min(o) AS opened FROM n WHERE action_type <> 'recheck' GROUP BY 1),
    v AS (SELECT n.* FROM n JOIN f USING (issue_id) WHERE n.o >= f.opened),
    m AS (SELECT issue_id, arg_max(CASE action_type WHEN 'dismissed' THEN 'dismissed' WHEN 'recheck' THEN new_status ELSE 'awaiting_verification' END, o) FILTER (action_type <> 'document_upload') AS last_status,
      count(*) FILTER (action_type <> 'recheck') AS actions_taken, max(o) FILTER (action_type = 'document_upload') AS up, max(o) FILTER (action_type = 'recheck') AS re FROM v GROUP BY 1)
    SELECT issue_id, coalesce(last_status, 'in_progress') AS status, actions_taken, up IS NOT NULL AND (re IS NULL OR up > re) AS recheck_pending FROM m""",
)
def issue_states(t: Tables) -> DataFrame:
    from casegrid.operators.issues import issue_states as states

    return states(t.actions)


@query(
    "F23 ST7",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, severity, count(*) AS alerts FROM alert_events WHERE severity IN ('warning', 'error', 'critical') GROUP BY 1, 2""",
)
def alerts_per_day(t: Tables) -> DataFrame:
    loud = t.alerts.where(codes.severity_at_least(F.col("severity"), "warning"))
    return loud.groupBy(F.date_format(F.window("ts", "1 day")["start"], "yyyy-MM-dd").alias("day"), "severity").agg(
        F.count(F.lit(1)).alias("alerts")
    )
