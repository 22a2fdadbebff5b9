"""Case tables derived from the supplied star-schema, event and text tables.

Every view is a narrow projection of a supplied table (plus one bucketed numbering for submission
versions), so the work of each query grows with those tables. `oracle_views.py` states the same views as SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.operators.ordered import number_within

# Words used for the derived case tables.
DOCUMENT_TYPE_BY_LINE = {
    1: "application_form",
    2: "location_plan",
    3: "site_plan",
    4: "floor_plan",
    5: "elevation",
    6: "design_statement",
    7: "heritage_statement",
}
RULE_BY_LINE = {1: "R1", 2: "R2", 3: "R3", 4: "R4", 5: "R5", 6: "R-DOC-001", 7: "R-DOC-002"}


def _by_line(mapping: dict[int, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[F.col("l_linenumber")]


class Tables:
    """Lazily built DataFrames over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, lines_by: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._lines_by = lines_by
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def by_submission(self) -> Tables:
        """The same tables, lines dealt by submission while each is one narrow row: grouping their fields needs no further shuffle."""
        return Tables(self.spark, self.sf_dir, "l_orderkey")

    @cached_property
    def by_document(self) -> Tables:
        """The same tables, lines dealt by document."""
        return Tables(self.spark, self.sf_dir, "document_id")

    # ---- case side -------------------------------------------------------------------------

    @cached_property
    def applications(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS id",
            "concat('APP/2024/', c_custkey) AS application_ref",
            "CASE WHEN c_custkey % 40 = 7 THEN NULL ELSE c_name END AS applicant_name",
            "concat(c_nationkey + 1, ' ', c_mktsegment, ' ROAD', "
            "CASE WHEN c_custkey % 4 <> 0 THEN concat(', WARD ', c_custkey % 7) ELSE '' END) AS site_address",
            "CASE c_custkey % 6 WHEN 0 THEN concat('Amendment to APP/2024/', c_custkey + 1) "
            "WHEN 1 THEN 'Rear extension to dwelling' WHEN 2 THEN 'New dwelling following refusal' "
            "WHEN 3 THEN 'Change of use' WHEN 4 THEN '' END AS proposal_description",
            "CASE c_mktsegment WHEN 'BUILDING' THEN 'full_planning' WHEN 'HOUSEHOLD' THEN 'householder' "
            "WHEN 'MACHINERY' THEN 'prior_approval' WHEN 'FURNITURE' THEN 'listed_building' "
            "ELSE 'major_application' END AS application_type",
            "CASE WHEN c_acctbal < 0 THEN 'in_review' WHEN c_acctbal < 5000 THEN 'open' ELSE 'closed' END AS status",
            "timestamp_seconds(1672531200 + pmod(cast(floor(c_acctbal) AS bigint), 365) * 86400) AS created_at",
        )

    @cached_property
    def submissions(self) -> DataFrame:
        base = self.raw("orders").selectExpr(
            "o_orderkey AS id",
            "o_custkey AS application_id",
            "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'needs_info' END AS status",
            "o_orderdate AS created_at",
            "o_orderpriority AS priority",
            "o_totalprice AS total_price",
        )
        numbered = number_within(
            base,
            keys=["application_id"],
            order=["created_at", "id"],
            bucket=F.date_trunc("month", "created_at"),
            number="__n",
            previous={"parent_submission_id": "id"},
        )
        return numbered.select(
            "id",
            "application_id",
            F.concat(F.lit("V"), F.col("__n") - 1).alias("submission_version"),
            "parent_submission_id",
            "status",
            "created_at",
            "priority",
            "total_price",
            (F.col("__n") - 1).alias("version_no"),
        )

    @cached_property
    def _lines(self) -> DataFrame:
        lines = self.raw("lineitem")
        document_id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        if self._lines_by is not None:
            lines = lines.repartition(document_id if self._lines_by == "document_id" else F.col(self._lines_by))
        return lines.withColumn("document_id", document_id)

    @cached_property
    def documents(self) -> DataFrame:
        return self._documents(self._lines)

    def documents_for(self, takers: DataFrame) -> DataFrame:
        """The documents of each ``owner``, as documents of each ``submission_id`` that takes them.

        Lines move while each is one narrow row and end dealt by the submission that takes them.
        """
        taken = self._lines.join(takers.withColumnRenamed("owner", "l_orderkey"), "l_orderkey")
        return self._documents(taken.withColumn("l_orderkey", F.col("submission_id")).drop("submission_id").repartition("l_orderkey"))

    @staticmethod
    def _documents(lines: DataFrame) -> DataFrame:
        return lines.withColumn("document_type", _by_line(DOCUMENT_TYPE_BY_LINE)).select(
            "document_id",
            F.col("l_orderkey").alias("submission_id"),
            F.concat("document_type", F.lit("_"), "l_partkey", F.lit(".pdf")).alias("filename"),
            "document_type",
            F.sha2(F.col("l_partkey").cast("string"), 256).alias("content_hash"),
            (F.col("l_linenumber") + 1).cast("long").alias("page_count"),
            F.col("l_shipdate").alias("uploaded_at"),
            F.concat(F.lit("azure://store/"), F.col("l_linestatus"), F.lit("/"), F.col("document_id")).alias("blob_uri"),
        )

    @cached_property
    def fields(self) -> DataFrame:
        def item(name: str, value: Column, unit: str | None) -> Column:
            return F.struct(
                F.lit(name).alias("field_name"),
                value.cast("string").alias("field_value"),
                F.lit(unit).cast("string").alias("field_unit"),
            )

        line, part, supplier = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
        items = F.array(
            item("floor_area", F.col("l_quantity"), "sqm"),
            item("ridge_height", F.round(F.col("l_tax") * 100, 1), "m"),
            item("boundary_distance", F.round(F.col("l_discount") * 100, 1), "m"),
            item("site_address", F.when(line == 5, "").otherwise(F.concat(supplier % 5 + 1, F.lit(" High Street"))), None),
            item("postcode", F.when(line != 6, F.concat(F.lit("B"), supplier % 3 + 1, F.lit(" "), part % 2 + 1, F.lit("AB"))), None),
            item("application_ref", F.concat(F.lit("APP/2024/"), "l_orderkey"), None),
        )
        return self._lines.select(
            F.col("l_orderkey").alias("submission_id"),
            "document_id",
            F.inline(items),
            F.when(line != 7, F.round(1 - F.col("l_discount"), 2)).alias("confidence"),
            F.when(F.col("l_returnflag") == "R", "regex")
            .when(F.col("l_returnflag") == "A", "heuristic")
            .otherwise("label")
            .alias("extractor"),
            F.col("l_shipdate").alias("created_at"),
        )

    @cached_property
    def pages(self) -> DataFrame:
        return self.documents.select("submission_id", "document_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("page_count"))).alias("page_number"))

    @cached_property
    def evidenced_fields(self) -> DataFrame:
        """Fields with an id of their own and the id of their evidence; references have none."""
        field_id = F.concat_ws(":", "document_id", "field_name")
        seen = F.when(F.col("field_name") != "application_ref", F.concat(F.lit("ev:"), field_id))
        return self.fields.select("*", field_id.alias("field_id"), seen.alias("evidence_id"))

    @cached_property
    def evidence(self) -> DataFrame:
        """The page of each field: the boundary's names a page that no document has."""
        part = lambda i: F.split("document_id", "-")[i].cast("long")
        page = (
            F.when(F.col("field_name") == "floor_area", part(1) % 2 + 1)
            .when(F.col("field_name") == "ridge_height", part(2) % 2 + 1)
            .when(F.col("field_name") == "boundary_distance", 99)
            .when(F.col("field_name") == "site_address", 1)
            .otherwise(2)
        )
        rows = self.evidenced_fields.where("evidence_id IS NOT NULL")
        return rows.select("evidence_id", "document_id", page.cast("long").alias("page_number"))

    @cached_property
    def rule_fields(self) -> DataFrame:
        """Answers and extracted values the rules look at, one row per (document, field), absent values left out."""
        items = {
            "proposed_use": "CASE WHEN l_partkey % 4 <> 0 THEN 'dwelling' END",
            "site_address": "CASE WHEN l_partkey % 3 <> 0 THEN concat(l_suppkey % 5 + 1, ' High Street') ELSE ' ' END",
            "application_ref": "concat('APP/2024/', l_orderkey)",
            "fee_amount": "CASE l_partkey % 10 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL ELSE cast(cast(l_quantity AS bigint) * 50 - 100 AS string) END",
            "fee_payment_status": "CASE l_returnflag WHEN 'A' THEN 'paid' WHEN 'R' THEN 'pending' END",
            "receipt_reference": "CASE WHEN l_suppkey % 7 = 0 THEN concat('RC', l_suppkey) END",
            "certificate_type": "CASE l_suppkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'owner b' WHEN 2 THEN 'x' WHEN 3 THEN '' WHEN 4 THEN 'D' END",
            "certificate_name": "CASE l_partkey % 3 WHEN 0 THEN 'Smith' WHEN 1 THEN 'Jones' END",
            "applicant_name": "CASE WHEN l_suppkey % 2 = 0 THEN 'Jane Smith' END",
            "listed_building": "CASE WHEN l_suppkey % 5 = 0 THEN 'True' ELSE 'False' END",
            "tpo": "CASE WHEN l_suppkey % 4 = 0 THEN 'true' END",
            "flood_zone": "CASE l_partkey % 5 WHEN 0 THEN 'Zone 2' WHEN 1 THEN 'zone 1' END",
            "constraint_evidence": "CASE WHEN l_partkey % 2 = 0 THEN 'map' END",
            "bng_applicable": "CASE l_partkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '' END",
            "bng_percentage": "CASE l_partkey % 3 WHEN 0 THEN '12' WHEN 1 THEN 'abc' ELSE '5' END",
            "bng_exemption_reason": "CASE WHEN l_suppkey % 3 = 0 THEN 'small site' END",
            "location_plan_scale": "CASE l_suppkey % 3 WHEN 0 THEN '1 : 1250 @A3' WHEN 1 THEN '1:500' END",
            "site_plan_north_arrow": "CASE WHEN l_partkey % 2 = 0 THEN 'true' END",
            "site_plan_scale_bar": "CASE WHEN l_suppkey % 2 = 0 THEN 'true' ELSE 'false' END",
            "registered_in_m3": "CASE WHEN l_partkey % 2 = 0 THEN 'true' END",
        }
        structs = ", ".join(f"named_struct('field_name', '{name}', 'field_value', {value})" for name, value in items.items())
        return self._lines.select(
            "document_id", F.col("l_orderkey").alias("submission_id"), F.col("l_shipdate").alias("created_at"), F.expr(f"inline(array({structs}))")
        ).where(F.col("field_value").isNotNull()).withColumn("confidence", F.lit(0.8))

    @cached_property
    def checks(self) -> DataFrame:
        return self._lines.select(
            F.col("document_id").alias("check_id"),
            F.col("l_orderkey").alias("submission_id"),
            "document_id",
            _by_line(RULE_BY_LINE).alias("rule_id"),
            F.when(F.col("l_returnflag") == "R", "fail")
            .when(F.col("l_returnflag") == "A", "needs_review")
            .otherwise("pass")
            .alias("status"),
            F.when(F.col("l_returnflag") == "R", "Missing required fields: site_address, proposed_use")
            .when(F.col("l_returnflag") == "A", "Inconsistent postcode")
            .otherwise("All required fields present.")
            .alias("explanation"),
            F.when(F.col("l_linenumber") <= 4, "error").otherwise("warning").alias("severity"),
            F.col("l_shipdate").alias("created_at"),
        )

    @cached_property
    def features(self) -> DataFrame:
        return self._lines.select(
            F.col("document_id").alias("feature_id"),
            F.col("l_orderkey").alias("submission_id"),
            F.when(F.col("l_suppkey") % 3 == 0, "boundary_fence")
            .when(F.col("l_suppkey") % 3 == 1, "rear_extension")
            .otherwise("main_building")
            .alias("feature_type"),
        )

    @cached_property
    def metrics(self) -> DataFrame:
        kind = F.col("l_linenumber") % 3
        return self._lines.select(
            F.col("document_id").alias("feature_id"),
            F.when(kind == 0, "setback_distance").when(kind == 1, "ridge_height").otherwise("floor_area").alias("metric_name"),
            (F.col("l_quantity") / 2).alias("metric_value"),
            F.when(kind == 2, "sqm").otherwise("m").alias("metric_unit"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS run_id",
            "CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_custkey END AS application_id",
            "concat(o_orderkey, '-direct') AS document_id",
            "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status",
            "o_orderdate AS started_at",
            "CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + make_interval(0, 0, 0, 0, cast(o_orderkey % 7 AS int)) END AS completed_at",
            "concat('{\"application_ref\":\"APP/2024/', o_custkey, '\",\"progress\":{\"current\":', o_orderkey % 5, "
            "'},\"summary\":{\"successes\":', o_orderkey % 3, ',\"failures\":', o_orderkey % 2, '}}') AS run_metadata",
        )

    @cached_property
    def run_documents(self) -> DataFrame:
        return self._lines.select(F.col("l_orderkey").alias("run_id"), "document_id")

    # ---- event side ------------------------------------------------------------------------

    @cached_property
    def actions(self) -> DataFrame:
        kind = F.col("event_type")
        return self.raw("events").select(
            F.col("event_id").alias("action_id"),
            F.col("user_id").alias("issue_id"),
            "ts",
            F.when(kind == "click", "document_upload")
            .when(kind == "view", "option_selection")
            .when(kind == "signup", "explanation_provided")
            .when(kind == "error", "dismissed")
            .otherwise("recheck")
            .alias("action_type"),
            F.when(kind == "purchase", F.when(F.col("value") > 20, "resolved").otherwise("open")).alias("new_status"),
        )

    @cached_property
    def decisions(self) -> DataFrame:
        kind = F.col("event_type")
        return self.raw("events").select(
            "event_id",
            F.col("user_id").alias("run_id"),
            F.get_json_object("props", "$.k").cast("long").alias("check_no"),
            F.when(kind.isin("click", "purchase"), "accept").when(kind == "view", "reject").otherwise("need_info").alias("decision"),
            "ts",
        )

    @cached_property
    def alerts(self) -> DataFrame:
        kind = F.col("event_type")
        return self.raw("events").select(
            F.col("event_id").alias("alert_id"),
            "ts",
            F.when(kind == "error", "critical")
            .when(kind == "purchase", "error")
            .when(kind == "signup", "warning")
            .when(kind == "click", "info")
            .otherwise("debug")
            .alias("severity"),
        )

    @cached_property
    def usage(self) -> DataFrame:
        return self.raw("conversations").selectExpr(
            "conv_id",
            "turn",
            "CASE conv_id % 4 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'my-GPT-4o-mini' WHEN 2 THEN 'text-embedding-3-small' ELSE 'local-model' END AS model",
            "role AS operation",
            "cast(size(split(trim(text), '[ \\\\t\\\\n\\\\r\\\\f]+')) AS bigint) AS input_tokens",
            "cast(length(text) AS bigint) AS output_tokens",
        )

    # ---- text side -------------------------------------------------------------------------

    @cached_property
    def layouts(self) -> DataFrame:
        """One layout row per text document: a few form lines derived from its keys, then all of its own lines."""
        form = [
            "CASE doc_id % 6 WHEN 0 THEN 'Application Form: householder planning application' "
            "WHEN 1 THEN 'Statement of display of a site notice' WHEN 2 THEN 'Site plan scale 1:500 @ A3' "
            "WHEN 3 THEN 'Proposed floor plan' WHEN 4 THEN 'Design and Access Statement' ELSE 'Covering letter' END",
            "CASE WHEN doc_id % 3 <> 2 THEN concat('Our ref PP-', 10000000 + doc_id) END",
            "CASE WHEN doc_id % 2 = 0 THEN 'Site location' END",
            "CASE WHEN doc_id % 4 = 0 THEN concat('Property Name: Unit ', doc_id % 26) END",
            "concat('Address Line 1: ', doc_id % 200 + 1, ' Dorset Road')",
            "CASE WHEN doc_id % 3 = 0 THEN 'Town/City: Saltley' END",
            "CASE WHEN doc_id % 5 <> 4 THEN concat('Postcode: B', doc_id % 20 + 1, ' ', doc_id % 9 + 1, 'AB') END",
            "CASE WHEN doc_id % 7 = 0 THEN 'City council PO Box 28 B1 1TU planning@example.org' END",
            "concat('Ridge height ', doc_id % 10 + 4, '.5 m above ground level for proposed extension')",
            "concat('Site area ', n_chars % 900 + 10, CASE doc_id % 3 WHEN 0 THEN ' sqm' WHEN 1 THEN ' ha' ELSE ' acres' END)",
            "concat('bedroom 1 floor area ', doc_id % 15 + 5, '.25 m2')",
            "CASE doc_id % 4 WHEN 0 THEN 'Certificate A ownership' WHEN 1 THEN 'I certify that notice has been given' "
            "WHEN 2 THEN 'Signed by: Jane Smith 12/03/2024' END",
            "CASE doc_id % 3 WHEN 0 THEN concat('Fee paid £', doc_id % 400 + 20, '.00') WHEN 1 THEN 'Fee exemption claimed' END",
            "CASE WHEN doc_id % 6 = 2 THEN 'North arrow' END",
            "CASE WHEN doc_id % 6 = 2 THEN concat('Drawing No: P', doc_id, ' Rev: B') END",
            "CASE WHEN doc_id % 6 = 2 THEN '0 5 10 m' END",
            "concat('Applicant name: Person ', doc_id)",
            "CASE doc_id % 8 WHEN 1 THEN 'THE PROPOSED CONVERSION OF A DWELLING TO HMO USE.' "
            "WHEN 2 THEN concat('I/We hereby apply for prior approval: change of use of offices to dwelling ', doc_id) END",
            "concat('applicant email user', doc_id, '@example.com tel 0121 555 ', lpad(doc_id % 10000, 4, '0'))",
        ]
        lines = F.concat(F.filter(F.array(*[F.expr(x) for x in form]), lambda x: x.isNotNull()), F.split("text", "\n"))
        blocks = F.transform(
            lines,
            lambda x, i: F.struct(
                x.alias("content"),
                (F.floor(i / 10) + 1).cast("long").alias("page_number"),
                i.cast("long").alias("index"),
                F.when(i == 0, "title").when(i % 10 == 5, "sectionHeading").alias("role"),
            ),
        )
        # a file of one row group is a single task; extraction is far dearer than moving the plain rows
        dealt = self.raw("documents").repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "text")
        return dealt.select("doc_id", "lang", "source", blocks.alias("text_blocks"))

    # ---- graph side ------------------------------------------------------------------------

    @cached_property
    def entities(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_brand AS app_id",
            "concat('e', p_partkey) AS id",
            "p_partkey AS ord",
            "concat(upper(p_name), CASE p_size % 4 WHEN 0 THEN ' AREA ' WHEN 1 THEN ' HEIGHT ' WHEN 2 THEN ' WALL ' ELSE ' ' END, p_partkey % 20) AS title",
            "CASE p_size % 6 WHEN 0 THEN 'Room' WHEN 1 THEN 'building' WHEN 2 THEN 'boundary' WHEN 3 THEN 'measurement' WHEN 4 THEN 'Measurement' ELSE 'thing' END AS type",
            "concat('form says ', p_size, ' sqm; drawing says ', p_partkey % 9 + p_size, '.5 m2 and ', p_partkey % 4 + 2, ' metres') AS description",
            "array(concat('tu', p_partkey % 97), concat('tu', p_partkey % 31)) AS text_unit_ids",
        )

    @cached_property
    def text_units(self) -> DataFrame:
        return self.raw("documents").selectExpr("concat('tu', doc_id) AS id", "cast(doc_id AS string) AS document_id")

    @cached_property
    def source_documents(self) -> DataFrame:
        return self.raw("documents").selectExpr(
            "cast(doc_id AS string) AS id",
            "concat(CASE doc_id % 4 WHEN 0 THEN 'application_form_' WHEN 1 THEN 'planning_statement_' WHEN 2 THEN 'floor_drawing_' ELSE 'letter_' END, doc_id, '.pdf') AS title",
        )

    @cached_property
    def relationships(self) -> DataFrame:
        entity = self.entities.select("app_id", "ord", "title")
        return (
            self.raw("lineitem")
            .join(entity.select("app_id", F.col("ord").alias("l_partkey"), F.col("title").alias("source")), "l_partkey")
            .join(entity.select(F.col("ord").alias("l_suppkey"), F.col("title").alias("target")), "l_suppkey")
            .selectExpr(
                "app_id",
                "l_orderkey * 8 + l_linenumber AS ord",
                "l_partkey * 100000 + l_suppkey AS ord2",
                "source",
                "lower(target) AS target",
                "CASE l_linenumber WHEN 1 THEN 'adjacent_to' WHEN 2 THEN 'contains' ELSE '' END AS type",
                "CASE l_linenumber WHEN 3 THEN 'door between' WHEN 4 THEN 'total area of' WHEN 5 THEN 'garden fence' "
                "WHEN 6 THEN 'source evidence' ELSE 'located near' END AS description",
                "l_quantity AS weight",
            )
        )

    @cached_property
    def form_claims(self) -> DataFrame:
        """Claims from extracted fields, keyed by submission."""
        return self.fields.select(
            F.col("submission_id").alias("app_id"),
            F.concat(F.lit("f:"), "document_id", F.lit(":"), "field_name").alias("node_id"),
            "field_name",
            F.coalesce("field_value", F.lit("")).alias("field_value"),
            "field_unit",
            F.lit("form").alias("source"),
        )

    @cached_property
    def geometry_claims(self) -> DataFrame:
        """Claims from spatial metrics, keyed by submission."""
        whole = self if self._lines_by is None else Tables(self.spark, self.sf_dir)  # joined by feature, whoever dealt the lines
        geometry = whole.features.join(whole.metrics, "feature_id").select(
            F.col("submission_id").alias("app_id"),
            F.concat(F.lit("g:"), "feature_id").alias("node_id"),
            F.col("metric_name").alias("field_name"),
            F.col("metric_value").cast("string").alias("field_value"),
            F.col("metric_unit").alias("field_unit"),
            F.lit("geometry").alias("source"),
        )
        # the join has dealt its rows by feature
        return geometry.repartition("app_id") if self._lines_by == "l_orderkey" else geometry

    @cached_property
    def claims(self) -> DataFrame:
        """Form claims from extracted fields and geometry claims from spatial metrics."""
        return self.form_claims.unionByName(self.geometry_claims)
