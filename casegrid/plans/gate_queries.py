"""Resolver gate, prompt context, chunking, keyword checks and issue record queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.functions.rule_catalog import FIELD_ALIASES, builtin_rules
from casegrid.operators import extract as E
from casegrid.operators import gate as G
from casegrid.operators import rules as V
from casegrid.plans.bridge import Tables
from casegrid.plans.registry import query
from casegrid.plans.text_queries import KEYS, extracted
from casegrid.session import cut_lineage


def text_subjects(layouts: DataFrame) -> DataFrame:
    """Documents with their extracted fields as a map; each text document is a submission of its own."""
    found = E.with_field_map(E.extract(layouts, KEYS), FIELD_ALIASES)
    return found.select(
        F.col("doc_id").alias("document_id"),
        F.col("doc_id").alias("submission_id"),
        "document_type",
        "application_type",
        "block_count",
        "fields",
        F.array("document_type").alias("present_types"),
        F.lit("V0").alias("submission_version"),
    )


def _text_findings(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Extraction is written once (the fields table of a real run) and read by both branches."""
    subjects = cut_lineage(text_subjects(t.layouts))
    return subjects, V.evaluate_rules(subjects, None, builtin_rules(t.spark))


@query("ST1 V16 E20 F22 E23 P4")
def extraction_to_findings(t: Tables) -> DataFrame:
    """From raw layouts to status counts per document type and rule, whole documents throughout."""
    subjects, findings = _text_findings(t)
    kinds = subjects.select("document_id", "document_type")
    return findings.join(kinds, "document_id").groupBy("document_type", "rule_id", "status").agg(F.count(F.lit(1)).alias("documents"))


@query("F22 E23 P4")
def resolver_requests(t: Tables) -> DataFrame:
    subjects, findings = _text_findings(t)
    fired = G.trigger(findings, subjects.select("document_id", "document_type", "block_count"))
    return G.requests(fired).select("document_id", F.array_join("asked_fields", ",").alias("asked_fields"), "payload")


@query("G17")
def extraction_kpis(t: Tables) -> DataFrame:
    subjects, findings = _text_findings(t)
    fired = G.trigger(findings, subjects.select("document_id", "document_type", "block_count")).select("document_id", "triggered")
    summary = V.summarise(findings).select("document_id", ((F.col("needs_review") == 0) & (F.col("fail") == 0)).alias("clean"))
    rows = (
        subjects.select(
            "document_id",
            "document_type",
            F.try_element_at("fields", F.lit("application_ref")).alias("application_ref"),
            F.try_element_at("fields", F.lit("applicant_email")).alias("applicant_email"),
        )
        .join(fired, "document_id", "left")
        .join(summary, "document_id", "left")
    )
    return G.extraction_kpis(rows)


@query(
    "G18",
    """WITH k AS (SELECT document_id, count(*) FILTER (status = 'pass') AS p, count(*) FILTER (status = 'needs_review') AS r, count(*) FILTER (status = 'fail') AS f,
      count(*) FILTER (status <> 'pass' AND severity = 'error') > 0 AS n FROM case_checks GROUP BY 1)
    SELECT concat('P:', p, ' R:', r, ' F:', f) AS outcome, count(*) AS documents, count(*) FILTER (n) AS needing_resolver FROM k GROUP BY 1""",
)
def outcome_histogram(t: Tables) -> DataFrame:
    return G.outcome_histogram(V.summarise(t.checks.withColumn("rule_severity", F.col("severity"))))


@query(
    "E22 T6 W13",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN role IS NOT NULL THEN 0 ELSE 1 END, idx) AS n FROM layout_blocks),
    p AS (SELECT doc_id, n, CASE WHEN role IS NOT NULL THEN concat('## ', content) ELSE content END AS part FROM o WHERE n <= 80 AND content <> ''),
    r AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM p)
    SELECT doc_id, md5(left(string_agg(part, chr(10) || chr(10) ORDER BY n), 6000)) AS context_md5 FROM r WHERE used < 6000 GROUP BY 1""",
)
def document_contexts(t: Tables) -> DataFrame:
    return t.layouts.select("doc_id", F.md5(G.document_context(F.col("text_blocks"))).alias("context_md5"))


@query(
    "E22 T5",
    """WITH k AS (SELECT unnest(['site address', 'look', 'for', 'address', 'information,', 'postcodes,', 'street', 'names']) AS w UNION ALL SELECT 'look' WHERE false),
    s AS (SELECT doc_id, idx, content, (SELECT count(*) FROM k WHERE contains(lower(content), w)) AS score FROM layout_blocks),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS n FROM s)
    SELECT doc_id, md5('Look for address information, postcodes, street names' || chr(10) || chr(10) || left(string_agg(content, chr(10) || chr(10) ORDER BY n) FILTER (content <> ''), 4000)) AS context_md5 FROM r WHERE n <= 30 GROUP BY 1""",
)
def address_contexts(t: Tables) -> DataFrame:
    return t.layouts.select("doc_id", F.md5(G.field_context(F.col("text_blocks"), "site_address")).alias("context_md5"))


@query(
    "E25",
    r"""WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' '), lambda x: x <> '') AS toks FROM documents),
    c AS (SELECT doc_id, toks, unnest(range(0, greatest(CAST(ceil((len(toks) - 300) / 200.0) AS BIGINT), 0) + 1)) AS chunk_no FROM w WHERE len(toks) > 0)
    SELECT doc_id, chunk_no, chunk_no * 200 AS start_token, len(toks[chunk_no * 200 + 1 : chunk_no * 200 + 300]) AS n_tokens, md5(array_to_string(toks[chunk_no * 200 + 1 : chunk_no * 200 + 300], ' ')) AS chunk_md5 FROM c""",
)
def token_chunks(t: Tables) -> DataFrame:
    chunks = G.token_chunks(t.raw("documents"), "text", "doc_id")
    return chunks.select("doc_id", "chunk_no", "start_token", "n_tokens", F.md5("chunk").alias("chunk_md5"))


@query(
    "X32 X2",
    r"""WITH e AS (SELECT doc_id, idx, trim(content) AS line FROM layout_blocks WHERE contains(content, ':')),
    k AS (SELECT doc_id, idx, trim(regexp_replace(replace(replace(replace(lower(trim(split_part(line, ':', 1))), '_', ' '), '-', ' '), ':', ''), '[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS label,
      trim(substr(line, strpos(line, ':') + 1)) AS value, trim(split_part(line, ':', 1)) AS raw FROM e)
    SELECT doc_id, label, value FROM k WHERE raw <> '' AND value <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY idx DESC) = 1""",
)
def label_index(t: Tables) -> DataFrame:
    return G.label_index(t.layouts, "doc_id")


@query("V17 X33 X34")
def single_field_checks(t: Tables) -> DataFrame:
    return G.single_field_checks(t.layouts, "doc_id")


@query("E21")
def document_evidence(t: Tables) -> DataFrame:
    """Evidence of all kinds counted per document, with the first snippets a finding would show."""
    rows = E.document_evidence(t.layouts, extracted(t), KEYS)
    # evidence is written once and read by both branches; only snippets that may be shown are kept
    kept = rows.withColumn("snippet", F.when(F.col("early"), F.col("snippet")))
    return E.evidence_summary(cut_lineage(kept), KEYS)


@query("F19")
def low_confidence_fields(t: Tables) -> DataFrame:
    return G.low_confidence(E.evidence_rows(extracted(t), KEYS))


@query(
    "V22 X26 G47",
    """SELECT CASE status WHEN 'fail' THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN contains(lower(rule_id), 'document') OR contains(lower(rule_id), 'missing') THEN 'missing_document' ELSE 'other' END AS category,
      CASE status WHEN 'fail' THEN 'provide_explanation' ELSE 'review_evidence' END AS action, count(*) AS issues, min(concat(submission_id, '_', rule_id, '_', document_id)) AS first_issue
    FROM case_checks WHERE status <> 'pass' GROUP BY 1, 2, 3""",
)
def issue_records(t: Tables) -> DataFrame:
    split = F.split(F.regexp_extract("explanation", "Missing required fields: (.+)", 1), ", ")
    missing = F.filter(split, lambda x: x != "")
    findings = t.checks.where("status <> 'pass'").select(
        "submission_id", "document_id", "rule_id", "status", F.col("explanation").alias("message"), missing.alias("missing_fields")
    )
    issues = G.issue_records(findings, F.col("submission_id"), F.col("document_id"))
    return issues.groupBy("severity", "category", "action").agg(F.count(F.lit(1)).alias("issues"), F.min("issue_id").alias("first_issue"))


@query(
    "D30 D31 G46",
    """WITH d AS (SELECT DISTINCT user_id AS issue_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS depends_on FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY ts, action_id) AS o FROM issue_actions),
    f AS (SELECT issue_id, min(o) AS opened FROM n WHERE action_type <> 'recheck' GROUP BY 1),
    s AS (SELECT n.issue_id, arg_max(CASE action_type WHEN 'dismissed' THEN 'dismissed' WHEN 'recheck' THEN new_status ELSE 'awaiting_verification' END, o) FILTER (action_type <> 'document_upload') AS st FROM n JOIN f USING (issue_id) WHERE n.o >= f.opened GROUP BY 1)
    SELECT d.issue_id, count(*) AS dependencies, count(*) FILTER (coalesce(s.st, '') <> 'resolved') AS open_dependencies, count(*) FILTER (coalesce(s.st, '') <> 'resolved') > 0 AS blocked FROM d LEFT JOIN s ON s.issue_id = d.depends_on GROUP BY 1""",
)
def issue_dependencies(t: Tables) -> DataFrame:
    from casegrid.operators.issues import dependency_state
    from casegrid.operators.issues import issue_states as states

    links = t.raw("events").select(F.col("user_id").alias("issue_id"), F.get_json_object("props", "$.k").cast("bigint").alias("depends_on"))
    return dependency_state(links, states(t.actions))
