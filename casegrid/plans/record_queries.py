"""Queries over single records: fields, overrides, feedback, evidence of findings, rule dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.operators import reports as R
from casegrid.operators import versions as V
from casegrid.operators.gate import pass_rate_by_type
from casegrid.operators.issues import cascade_recheck, issue_states
from casegrid.operators.rules import evidence_on_finding
from casegrid.plans.bridge import Tables
from casegrid.plans.case_queries import _overrides
from casegrid.plans.registry import query


@query(
    "F1 F2 T1 T2",
    """WITH hit AS (SELECT * FROM case_fields WHERE field_name = 'postcode' AND field_value ILIKE '%b2%')
    SELECT submission_id, document_id, field_name, field_value, confidence, created_at, (SELECT count(*) FROM hit) AS total_count
    FROM hit ORDER BY created_at, submission_id, document_id, field_name LIMIT 40 OFFSET 40""",
)
def search_fields(t: Tables) -> DataFrame:
    return R.search_fields(t.fields, name="postcode", value="b2", number=2, size=40)


@query(
    "F2 T1",
    """SELECT submission_id, document_id, field_name, field_value, confidence, created_at, count(*) OVER () AS total_count
    FROM case_fields WHERE submission_id = (SELECT min(submission_id) FROM case_fields) ORDER BY created_at, submission_id, document_id, field_name LIMIT 50""",
)
def fields_of_submission(t: Tables) -> DataFrame:
    first = t.fields.agg(F.min("submission_id")).first()[0]
    return R.search_fields(t.fields, filters={"submission_id": first})


@query(
    "T9 D23",
    """SELECT concat('c', check_no) AS check_id, event_id AS override_id, CASE WHEN run_id % 10 = 0 THEN NULL ELSE concat('officer-', run_id % 50) END AS officer_id,
      CASE decision WHEN 'accept' THEN 'pass' ELSE 'fail' END AS override_status, ts AS created_at,
      row_number() OVER (PARTITION BY check_no ORDER BY ts DESC, event_id DESC) AS place
    FROM review_events WHERE decision <> 'need_info'""",
)
def override_history(t: Tables) -> DataFrame:
    return R.override_history(_overrides(t))


def _feedback(t: Tables) -> DataFrame:
    return t.decisions.select(
        F.col("event_id").alias("feedback_id"),
        (F.col("check_no") % 40).alias("validation_check_id"),
        (F.col("run_id") % 20).alias("document_id"),
        (F.col("check_no") % 3 + 1).cast("int").alias("page_number"),
        F.concat(F.lit("officer-"), F.col("run_id") % 5).alias("reviewer_id"),
        (F.col("decision") == "accept").alias("is_relevant"),
        F.col("ts").alias("created_at"),
    )


_FEEDBACK = """f AS (SELECT event_id, check_no % 40 AS validation_check_id, run_id % 20 AS document_id, CAST(check_no % 3 + 1 AS INTEGER) AS page_number,
      concat('officer-', run_id % 5) AS reviewer_id, decision = 'accept' AS is_relevant, ts AS created_at FROM review_events),
    kept AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY validation_check_id, document_id, page_number, reviewer_id ORDER BY created_at DESC, event_id DESC) = 1)"""


@query("D25", f"WITH {_FEEDBACK} SELECT validation_check_id, document_id, page_number, reviewer_id, is_relevant, created_at FROM kept")
def evidence_feedback(t: Tables) -> DataFrame:
    return R.latest_feedback(_feedback(t))


@query(
    "D25 G19",
    f"""WITH {_FEEDBACK} SELECT validation_check_id, count(*) AS judgements, count(*) FILTER (is_relevant) AS relevant, count(*) FILTER (NOT is_relevant) AS irrelevant
    FROM kept GROUP BY 1""",
)
def feedback_summary(t: Tables) -> DataFrame:
    return R.feedback_summary(_feedback(t))


@query(
    "V19 W14 X6",
    r"""WITH e AS (SELECT doc_id, idx, page_number AS page, content AS snippet, CASE WHEN starts_with(content, 'Site ') THEN 'site' WHEN contains(content, ': ') THEN 'labelled' ELSE 'text' END AS k FROM layout_blocks),
    first AS (SELECT doc_id, k, min(idx) AS at FROM e GROUP BY 1, 2),
    usable AS (SELECT e.*, row_number() OVER (PARTITION BY doc_id, k ORDER BY idx) AS n FROM e WHERE snippet <> ''),
    five AS (SELECT u.*, row_number() OVER (PARTITION BY u.doc_id ORDER BY f.at, u.idx) AS place FROM usable u JOIN first f USING (doc_id, k) WHERE n <= 3)
    SELECT doc_id, place, k AS evidence_key, page, snippet FROM five WHERE place <= 5""",
)
def finding_evidence(t: Tables) -> DataFrame:
    """At most three snippets per key and five in all, keys in the order in which a document first has them."""
    key = lambda b: (
        F.when(b["content"].startswith("Site "), "site").when(b["content"].contains(": "), "labelled").otherwise("text")
    )
    evidence = F.transform("text_blocks", lambda b: F.struct(key(b).alias("evidence_key"), b["page_number"].alias("page"), b["content"].alias("snippet")))
    listed = t.layouts.select("doc_id", evidence.alias("evidence")).select("doc_id", F.posexplode(evidence_on_finding(F.col("evidence"))).alias("i", "e"))
    return listed.select("doc_id", (F.col("i") + 1).cast("long").alias("place"), "e.evidence_key", "e.page", "e.snippet")


@query(
    "D7",
    """WITH fwd AS (SELECT DISTINCT concat('R', p_partkey) AS rule_id, concat('R', unnest([p_partkey % 97, p_size, p_partkey + 1])) AS other FROM part)
    SELECT rule_id, other, 'triggers' AS direction FROM fwd
    UNION ALL SELECT other, rule_id, 'triggered_by' FROM fwd WHERE other IN (SELECT concat('R', p_partkey) FROM part)""",
)
def rule_dependency_rows(t: Tables) -> DataFrame:
    others = F.array(F.col("p_partkey") % 97, F.col("p_size").cast("long"), F.col("p_partkey") + 1)
    rules = t.raw("part").select(
        F.concat(F.lit("R"), "p_partkey").alias("rule_id"), F.transform(others, lambda x: F.concat(F.lit("R"), x)).alias("triggers_rules")
    )
    return V.dependency_rows(rules)


@query(
    "D31 G46",
    """WITH d AS (SELECT DISTINCT user_id AS issue_id, (user_id * 7 + 3) % 200 AS depends_on FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY ts, action_id) AS o FROM issue_actions),
    f AS (SELECT issue_id, min(o) AS opened FROM n WHERE action_type <> 'recheck' GROUP BY 1),
    s AS (SELECT n.issue_id, arg_max(CASE action_type WHEN 'dismissed' THEN 'dismissed' WHEN 'recheck' THEN new_status ELSE 'awaiting_verification' END, o) FILTER (action_type <> 'document_upload') AS st FROM n JOIN f USING (issue_id) WHERE n.o >= f.opened GROUP BY 1)
    SELECT d.issue_id, count(*) AS dependencies FROM d LEFT JOIN s ON s.issue_id = d.depends_on GROUP BY 1 HAVING count(*) FILTER (coalesce(s.st, '') <> 'resolved') = 0""",
)
def recheckable_issues(t: Tables) -> DataFrame:
    links = t.raw("events").select(F.col("user_id").alias("issue_id"), ((F.col("user_id") * 7 + 3) % 200).alias("depends_on"))
    return cascade_recheck(links, issue_states(t.actions))


@query(
    "G17",
    """SELECT d.document_type, count(*) AS documents, round(count(*) FILTER (c.status <> 'fail') / count(*), 6) AS pass_rate
    FROM case_documents d JOIN case_checks c ON c.document_id = d.document_id GROUP BY 1""",
)
def pass_rate_per_type(t: Tables) -> DataFrame:
    failed = t.checks.groupBy("document_id").agg((~F.bool_or(F.col("status") == "fail")).alias("clean"))
    return pass_rate_by_type(t.documents.join(failed, "document_id"))
