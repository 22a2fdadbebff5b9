"""Streaming operations run over the supplied events, and page quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.plans.bridge import Tables
from casegrid.plans.registry import query
from casegrid.sources import files as S
from casegrid.sources import layout as L
from casegrid.streaming import jobs as J


@query(
    "ST5 F23",
    """WITH RECURSIVE a AS (SELECT severity AS limiter, epoch(ts) AS s, row_number() OVER (PARTITION BY severity ORDER BY ts, alert_id) AS n FROM alert_events),
    r(limiter, n, ok, last_sent, one_before) AS (
      SELECT DISTINCT limiter, CAST(0 AS BIGINT), false, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM a
      UNION ALL
      SELECT a.limiter, a.n, r.one_before IS NULL OR r.one_before <= a.s - 600,
        CASE WHEN r.one_before IS NULL OR r.one_before <= a.s - 600 THEN a.s ELSE r.last_sent END,
        CASE WHEN r.one_before IS NULL OR r.one_before <= a.s - 600 THEN r.last_sent ELSE r.one_before END
      FROM r JOIN a ON a.limiter = r.limiter AND a.n = r.n + 1)
    SELECT limiter, count(*) AS alerts, count(*) FILTER (ok) AS sent FROM r WHERE n > 0 GROUP BY 1""",
)
def alert_throttle(t: Tables) -> DataFrame:
    """Per severity: alerts raised and sent when two may pass in any ten minutes."""
    alerts = t.alerts.select(F.col("severity").alias("limiter"), "alert_id", "ts")
    sent = J.throttle(alerts, window=600, most=2)
    return sent.groupBy("limiter").agg(F.count(F.lit(1)).alias("alerts"), F.count_if("sent").alias("sent"))


@query(
    "ST3",
    "SELECT user_id AS run_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS updated_at, count(*) AS events FROM events GROUP BY 1",
)
def live_run_status(t: Tables) -> DataFrame:
    return J.run_status(t.raw("events").select(F.col("user_id").alias("run_id"), "ts", "event_id", F.col("event_type").alias("status")))


@query(
    "ST8 D25",
    """WITH e AS (SELECT run_id, check_no, decision, ts, event_id FROM review_events) SELECT run_id, check_no, decision FROM e QUALIFY row_number() OVER (PARTITION BY run_id, check_no ORDER BY ts DESC, event_id DESC) = 1""",
)
def decision_snapshot(t: Tables) -> DataFrame:
    """Decisions applied in two batches, an even and an odd one, to one snapshot."""
    rows = t.decisions.select("run_id", "check_no", "decision", "ts", "event_id")
    keys, order = ["run_id", "check_no"], ["ts", "event_id"]
    first = J.upsert_latest(rows.where("false"), rows.where("event_id % 2 = 0"), keys, order)
    return J.upsert_latest(first, rows.where("event_id % 2 = 1"), keys, order).select("run_id", "check_no", "decision")


@query(
    "D17",
    "SELECT count(*) AS first_arrivals FROM (SELECT DISTINCT content_hash FROM case_documents)",
)
def first_arrivals(t: Tables) -> DataFrame:
    return t.documents.groupBy("content_hash").agg(F.min("uploaded_at").alias("first")).agg(F.count(F.lit(1)).alias("first_arrivals"))


@query(
    "G43 S19",
    """WITH p AS (SELECT doc_id, page_number, coalesce(string_agg(content, chr(10) ORDER BY idx) FILTER (content <> ''), '') AS txt FROM layout_blocks GROUP BY 1, 2),
    k AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (length(trim(txt)) < 400) AS short_pages FROM p GROUP BY 1) SELECT * FROM k WHERE short_pages > pages / 2""",
)
def low_text_documents(t: Tables) -> DataFrame:
    return S.low_text_documents(L.page_texts(t.layouts, "doc_id"), shortest=400)


@query(
    "J27",
    """WITH c(field_name, category) AS (VALUES ('floor_area', 'Development Details'), ('site_address', 'Site & Applicant'), ('postcode', 'Site & Applicant'), ('application_ref', 'Application Details'))
    SELECT coalesce(c.category, 'Uncategorised') AS category, count(*) AS fields FROM case_fields LEFT JOIN c USING (field_name) GROUP BY 1""",
)
def fields_by_category(t: Tables) -> DataFrame:
    from casegrid.functions.categories import categorised

    return categorised(t.fields).groupBy("category").agg(F.count(F.lit(1)).alias("fields"))


@query(
    "S8 X27",
    """SELECT admit_status, count(*) AS files FROM (SELECT CASE WHEN l_partkey % 7 = 0 THEN 'rejected_type' WHEN l_quantity < 2 THEN 'rejected_empty' WHEN l_quantity > 49 THEN 'large' ELSE 'ok' END AS admit_status FROM lineitem) GROUP BY 1""",
)
def file_admission(t: Tables) -> DataFrame:
    lines = t.raw("lineitem")
    size = F.when(F.col("l_quantity") < 2, 0).when(F.col("l_quantity") > 49, S.LARGE_FILE + 1).otherwise(F.col("l_quantity")).cast("long")
    files = lines.select(
        F.concat(F.lit("in/"), "l_orderkey", F.when(F.col("l_partkey") % 7 == 0, ".docx").otherwise(".PDF")).alias("path"), size.alias("length")
    )
    return S.admitted(files).groupBy("admit_status").agg(F.count(F.lit(1)).alias("files"))


@query(
    "J9 V20",
    """WITH c AS (SELECT check_id, unnest([CAST(split_part(check_id, '-', 4) AS BIGINT), CAST(split_part(check_id, '-', 4) AS BIGINT) + 1]) AS evidence_id FROM case_checks)
    SELECT s_nationkey, count(*) AS links, count(DISTINCT c.check_id) AS checks FROM c LEFT JOIN supplier ON s_suppkey = evidence_id GROUP BY 1""",
)
def check_evidence(t: Tables) -> DataFrame:
    from casegrid.operators.reports import check_evidence as linked

    own = F.split("check_id", "-")[3].cast("bigint")
    checks = t.checks.select("check_id", F.array(own, own + 1).alias("evidence_ids"))
    evidence = t.raw("supplier").select(F.col("s_suppkey").alias("evidence_id"), "s_nationkey")
    rows = linked(checks, evidence)
    per_check = rows.groupBy("s_nationkey", "check_id").agg(F.count(F.lit(1)).alias("n"))
    return per_check.groupBy("s_nationkey").agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("checks"))


@query(
    "X22 X10",
    """SELECT event_id, CASE event_type WHEN 'click' THEN concat(value, ' metres (height)') WHEN 'view' THEN concat('• ', value, ' square metres (from: raw)') WHEN 'error' THEN 'None' WHEN 'signup' THEN concat(event_id, ', x') ELSE props END AS shown FROM events""",
)
def formatted_values(t: Tables) -> DataFrame:
    from casegrid.functions.text import format_json

    kind, value = F.col("event_type"), F.col("value").cast("string")
    stored = (
        F.when(kind == "click", F.concat(F.lit("{'value': "), value, F.lit(", 'unit': 'm', 'context': 'height'}")))
        .when(kind == "view", F.concat(F.lit('[{"value": '), value, F.lit(', "unit": "sqm", "context": "unknown", "raw_text": "raw"}]')))
        .when(kind == "error", "[]")
        .when(kind == "signup", F.concat(F.lit('["'), "event_id", F.lit('", "x"]')))
        .otherwise(F.col("props"))
    )
    return t.raw("events").select("event_id", format_json(stored).alias("shown"))


@query(
    "X36",
    """SELECT event_id, concat('a=', event_type, ',k=', json_extract_string(props, '$.k'), CASE WHEN event_id % 2 = 0 THEN ',z=1' ELSE '' END) AS merged FROM events""",
)
def merged_metadata(t: Tables) -> DataFrame:
    from casegrid.operators.reports import merge_metadata

    stored = F.from_json("props", "map<string,string>")
    base = F.map_concat(stored, F.create_map(F.lit("a"), F.lit("old")))
    update = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("a"), F.col("event_type"), F.lit("z"), F.lit("1"))).otherwise(
        F.create_map(F.lit("a"), F.col("event_type"))
    )
    entries = F.array_sort(F.map_entries(merge_metadata(base, update)))
    return t.raw("events").select("event_id", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("merged"))
