"""Case tables on disk: explicit schemas, scans, parametrised SQL and keyed views."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS: dict[str, str] = {
    "applications": "id long, application_ref string, applicant_name string, site_address string, proposal_description string, application_date timestamp, created_at timestamp",
    "submissions": "id long, planning_case_id long, submission_version string, parent_submission_id long, status string, submission_metadata string, submission_type string, submission_type_confidence double, submission_type_source string, application_type string, created_at timestamp",
    "documents": "id long, submission_id long, application_id long, blob_uri string, filename string, content_hash string, page_count int, document_type string, uploaded_at timestamp, processed_at timestamp",
    "pages": "id long, document_id long, page_number int, page_metadata string",
    "evidence": "id long, document_id long, page_id long, page_number int, evidence_type string, evidence_key string, bbox struct<x1:double,y1:double,x2:double,y2:double,x3:double,y3:double,x4:double,y4:double>, snippet string, content string, confidence double",
    "extracted_fields": "id long, submission_id long, field_name string, field_value string, field_unit string, confidence double, extractor string, evidence_id long, conflict_flag string, created_at timestamp",
    "geometry_features": "id long, submission_id long, feature_type string, geometry_json string",
    "spatial_metrics": "id long, geometry_feature_id long, metric_name string, metric_value double, metric_unit string",
    "change_sets": "id long, submission_id long, parent_submission_id long, significance_score double, requires_validation string, created_at timestamp",
    "change_items": "id long, change_set_id long, change_type string, field_key string, document_type string, old_value string, new_value string, change_metadata string",
    "rules": "id long, rule_id string, rule_category string, required_fields array<string>, severity string, rule_config string, is_active string",
    "validation_checks": "id long, submission_id long, document_id long, rule_id long, rule_id_string string, status string, explanation string, evidence_ids array<long>, evidence_details string, candidate_documents string, created_at timestamp",
    "validation_results": "id long, document_id long, field_name string, status string, confidence double, extracted_value string, rule_name string, error_message string",
    "artefacts": "id long, document_id long, artefact_type string, blob_uri string, created_at timestamp, artefact_metadata string",
    "officer_overrides": "override_id long, validation_check_id long, original_status string, override_status string, notes string, officer_id string, created_at timestamp",
    "field_resolutions": "resolution_id long, submission_id long, field_key string, chosen_value string, officer_id string, notes string, created_at timestamp",
    "runs": "id long, run_type string, document_id long, application_id long, started_at timestamp, completed_at timestamp, status string, error_message string, run_metadata string",
    "run_documents": "run_id long, document_id long",
    "issue_resolutions": "id long, run_id long, issue_id string, status string, recheck_pending int, created_at timestamp",
    "resolution_actions": "id long, issue_resolution_id long, action_type string, action_data string, performed_by string, created_at timestamp",
    "recheck_history": "id long, issue_resolution_id long, previous_status string, new_status string, created_at timestamp",
    "issue_dependencies": "id long, issue_id string, depends_on_issue_id string, dependency_type string",
    "review_decisions": "id long, validation_check_id long, run_id long, reviewer_id string, decision string, comment string, created_at timestamp",
    "evidence_feedback": "id long, validation_check_id long, document_id long, page_number int, is_relevant boolean, reviewer_id string, created_at timestamp",
}

# Words allowed in status-like columns.
DOMAINS: dict[tuple[str, str], list[str]] = {
    ("validation_checks", "status"): ["pass", "fail", "needs_review", "pending"],
    ("officer_overrides", "override_status"): ["pass", "fail", "needs_review"],
    ("change_sets", "requires_validation"): ["yes", "partial", "no"],
    ("rules", "is_active"): ["yes", "no"],
    ("review_decisions", "decision"): ["accept", "reject", "need_info"],
}


def schema_of(name: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[name])


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan a case table; the declared schema keeps the read narrow and free of inference."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root.rstrip('/')}/{name}")


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """Scan a case table from a relational database in ``parts`` parallel key ranges."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=name, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options
    )
    return reader.load()


def domain_violations(df: DataFrame, table: str) -> DataFrame:
    """Rows whose status-like columns hold a word outside the allowed set."""
    bad = F.lit(False)
    for (owner, column), words in DOMAINS.items():
        if owner == table:
            bad = bad | (F.col(column).isNotNull() & ~F.col(column).isin(words))
    return df.where(bad)


def run_sql(spark: SparkSession, statement: str, frames: Mapping[str, DataFrame], params: Mapping[str, object] | None = None) -> DataFrame:
    """Parametrised SQL: ``{name}`` stands for a DataFrame, ``:name`` for a value. Values are never spliced in."""
    return spark.sql(statement, args=dict(params or {}), **frames)


def for_key(df: DataFrame, key: str, value, *order: str) -> DataFrame:
    """Rows of one owner in a stated order; the equality reaches the scan."""
    rows = df.where(F.col(key) == F.lit(value))
    return rows.orderBy(*order) if order else rows
