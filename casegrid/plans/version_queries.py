"""Version, lineage, integrity and comparison queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.functions.rule_catalog import builtin_rules
from casegrid.operators import lineage as L
from casegrid.operators import reports as R
from casegrid.operators import versions as V
from casegrid.plans.bridge import Tables
from casegrid.plans.case_queries import CHANGE_ITEMS_SQL, all_change_sets, all_items
from casegrid.plans.registry import query

_DECLARED = """declared AS (SELECT id, application_id, submission_version, status, created_at,
  CASE WHEN parent_submission_id IS NULL THEN NULL WHEN id % 3 = 0 THEN id + 1000000000 WHEN id % 3 = 1 THEN id - 1 ELSE parent_submission_id END AS parent_submission_id FROM submissions)"""


def _declared(t: Tables) -> DataFrame:
    """Submissions whose stated parents are partly wrong, as an integrity check would meet them."""
    own = F.col("parent_submission_id")
    stated = F.when(F.col("id") % 3 == 0, F.col("id") + 1000000000).when(F.col("id") % 3 == 1, F.col("id") - 1).otherwise(own)
    return t.submissions.select(
        "id", "application_id", "submission_version", "status", "created_at", F.when(own.isNotNull(), stated).alias("parent_submission_id")
    )


@query("D1 D2 D3 J7 J26 U6 U7 U8 U10", f"WITH {CHANGE_ITEMS_SQL} SELECT submission_id, change_type, field_key, document_type, old_value, new_value, action FROM items")
def change_items(t: Tables) -> DataFrame:
    return all_items(t)


@query("D4 G27 G28 W17", f"WITH {CHANGE_ITEMS_SQL} SELECT * FROM change_sets")
def change_sets(t: Tables) -> DataFrame:
    return all_change_sets(t)


@query(
    "D21 G1",
    """WITH c AS (SELECT submission_id, count(*) FILTER (status = 'pass') AS p, count(*) FILTER (status = 'fail') AS f, count(*) FILTER (status = 'needs_review') AS r FROM case_checks GROUP BY 1),
    d AS (SELECT submission_id, count(*) AS n FROM case_documents GROUP BY 1)
    SELECT s.application_id, s.id AS submission_id, s.submission_version, s.parent_submission_id, coalesce(p, 0) AS pass_count, coalesce(f, 0) AS fail_count, coalesce(r, 0) AS needs_review_count,
      coalesce(d.n, 0) AS documents FROM submissions s LEFT JOIN c ON c.submission_id = s.id LEFT JOIN d ON d.submission_id = s.id""",
)
def version_overview(t: Tables) -> DataFrame:
    counts = R.status_counts(t.checks, "submission_id").drop("total_count")
    docs = t.documents.groupBy("submission_id").agg(F.count(F.lit(1)).alias("documents"))
    rows = t.submissions.select("application_id", F.col("id").alias("submission_id"), "submission_version", "parent_submission_id")
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("pass_count", "fail_count", "needs_review_count", "documents")]
    return (
        rows.join(counts, "submission_id", "left")
        .join(docs, "submission_id", "left")
        .select("application_id", "submission_id", "submission_version", "parent_submission_id", *filled)
    )


@query(
    "D5",
    f"""WITH {CHANGE_ITEMS_SQL}, rules(rule_id, f) AS (VALUES ('R1', 'site_address'), ('R1-SITE-NOTICE', 'site_address'), ('R1-SITE-NOTICE', 'postcode'), ('R3', 'application_ref'),
      ('R-CONS-001', 'postcode'), ('R-CONS-002', 'site_address'), ('R-CONS-003', 'application_ref'))
    SELECT DISTINCT submission_id, rule_id FROM items JOIN rules ON f = field_key WHERE change_type = 'field_delta'""",
)
def impacted_rules(t: Tables) -> DataFrame:
    return V.impacted_rules(all_items(t), builtin_rules(t.spark))


_DEPENDENT_RULES = [
    ("A-1", ["site_address"], {"floor_area": "high"}, ["A-2"]),
    ("A-2", [], {"postcode": "low"}, ["A-3"]),
    ("A-3", ["ridge_height"], {}, ["A-1"]),
    ("A-4", [], {"boundary_distance": "critical", "postcode": "medium"}, []),
    ("A-5", ["application_ref"], {"application_ref": "low"}, ["A-4"]),
]


def _dependent_rules(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(
        _DEPENDENT_RULES, "rule_id string, required_fields array<string>, dependent_fields map<string,string>, triggers_rules array<string>"
    )


@query(
    "D6 X31",
    f"""WITH RECURSIVE {CHANGE_ITEMS_SQL},
    seed(rule_id, f) AS (VALUES ('A-1', 'floor_area'), ('A-1', 'site_address'), ('A-3', 'ridge_height'), ('A-4', 'boundary_distance'), ('A-4', 'postcode')),
    trig(a, b) AS (VALUES ('A-1', 'A-2'), ('A-2', 'A-3'), ('A-3', 'A-1'), ('A-5', 'A-4')),
    reach(k, rule_id) AS (SELECT DISTINCT submission_id, rule_id FROM fdelta JOIN seed ON f = field_key UNION SELECT k, b FROM reach JOIN trig ON a = rule_id)
    SELECT k AS submission_id, rule_id FROM reach""",
)
def rule_cascade(t: Tables) -> DataFrame:
    items = V.field_deltas(V.version_pairs(t.submissions), t.by_submission.fields)
    changes = items.select(F.col("submission_id").alias("key"), F.col("field_key").alias("field"))
    return V.cascade_rules(changes, _dependent_rules(t)).withColumnRenamed("key", "submission_id")


@query(
    "D13 J5",
    f"""WITH {_DECLARED} SELECT d.id, d.application_id, d.parent_submission_id, CASE WHEN p.id IS NULL THEN 'orphan' ELSE 'cross_application' END AS problem
    FROM declared d LEFT JOIN declared p ON p.id = d.parent_submission_id WHERE d.parent_submission_id IS NOT NULL AND (p.id IS NULL OR p.application_id <> d.application_id)""",
)
def parent_integrity(t: Tables) -> DataFrame:
    return V.parent_integrity(_declared(t))


@query(
    "D14",
    f"""WITH {_DECLARED} SELECT d.id, d.application_id, d.submission_version, p.id AS parent_submission_id FROM declared d LEFT JOIN declared p ON p.id = d.parent_submission_id""",
)
def orphan_repair(t: Tables) -> DataFrame:
    return V.repair_orphans(_declared(t)).select("id", "application_id", "submission_version", "parent_submission_id")


@query(
    "W5 W6",
    """WITH n AS (SELECT id, application_id, CASE WHEN id % 11 = 0 THEN concat('V', version_no + 1) ELSE submission_version END AS submission_version,
      concat('V', row_number() OVER (PARTITION BY application_id ORDER BY created_at, id) - 1) AS expected_version FROM submissions)
    SELECT application_id, id, submission_version, expected_version FROM n WHERE submission_version <> expected_version""",
)
def version_sequence(t: Tables) -> DataFrame:
    shifted = F.when(F.col("id") % 11 == 0, V.next_version(F.col("submission_version"))).otherwise(F.col("submission_version"))
    return V.version_sequence(t.submissions.withColumn("submission_version", shifted))


@query(
    "D13",
    f"""WITH {_DECLARED} SELECT s.id AS submission_id, s.parent_submission_id AS parent_id, d.parent_submission_id FROM submissions s JOIN declared d ON d.id = s.id
    WHERE s.parent_submission_id IS NOT NULL AND d.parent_submission_id IS DISTINCT FROM s.parent_submission_id""",
)
def changeset_mismatch(t: Tables) -> DataFrame:
    return V.changeset_mismatch(_declared(t), V.version_pairs(t.submissions))


@query(
    "D9",
    f"""WITH {_DECLARED}, n AS (SELECT submission_id, count(*) AS c FROM case_documents GROUP BY 1),
    r AS (SELECT d.id, d.submission_version, d.status, CASE WHEN d.submission_version = 'V0' THEN 'not_a_modification' WHEN d.parent_submission_id IS NULL THEN 'no_parent' WHEN p.id IS NULL THEN 'parent_not_found'
      WHEN coalesce(n.c, 0) = 0 THEN 'no_documents' ELSE 'eligible' END AS reason FROM declared d LEFT JOIN declared p ON p.id = d.parent_submission_id LEFT JOIN n ON n.submission_id = d.id)
    SELECT id, submission_version, reason, CASE WHEN reason IN ('no_parent', 'parent_not_found') THEN 'needs_review' ELSE status END AS status FROM r""",
)
def modification_eligibility(t: Tables) -> DataFrame:
    return V.modification_eligibility(_declared(t), t.documents)


@query(
    "D20 U1 U2 U3 F10",
    """WITH pairs AS (SELECT id AS submission_id, parent_submission_id AS parent_id FROM submissions WHERE parent_submission_id IS NOT NULL),
    k AS (SELECT submission_id, rule_id, split_part(document_id, '-', 4) AS document_key, max(status) AS status FROM case_checks GROUP BY 1, 2, 3),
    a AS (SELECT p.submission_id, rule_id, document_key, status FROM pairs p JOIN k ON k.submission_id = p.parent_id),
    b AS (SELECT p.submission_id, rule_id, document_key, status FROM pairs p JOIN k ON k.submission_id = p.submission_id),
    j AS (SELECT coalesce(a.submission_id, b.submission_id) AS submission_id, coalesce(a.rule_id, b.rule_id) AS rule_id, coalesce(a.document_key, b.document_key) AS document_key, a.status AS from_status, b.status AS to_status
      FROM a FULL JOIN b ON a.submission_id = b.submission_id AND a.rule_id = b.rule_id AND a.document_key = b.document_key),
    m AS (SELECT *, from_status IS NOT NULL AND from_status <> 'pass' AS was, to_status IS NOT NULL AND to_status <> 'pass' AS now FROM j)
    SELECT submission_id, rule_id, document_key, from_status, to_status, 'new_issue' AS kind FROM m WHERE now AND NOT was
    UNION ALL SELECT submission_id, rule_id, document_key, from_status, to_status, 'resolved_issue' FROM m WHERE was AND NOT now
    UNION ALL SELECT submission_id, rule_id, document_key, from_status, to_status, 'status_change' FROM m WHERE from_status <> to_status""",
)
def version_finding_changes(t: Tables) -> DataFrame:
    """Findings of every submission compared with those of its parent; documents are identified by supplier number."""
    pairs = V.version_pairs(t.submissions)
    keyed = t.checks.groupBy(
        F.col("submission_id").alias("owner"), "rule_id", F.split("document_id", "-")[3].alias("document_key")
    ).agg(F.max("status").alias("status"))
    columns = ["submission_id", "rule_id", "document_key", "status"]
    before = pairs.join(keyed, pairs.parent_id == keyed.owner).select(*columns)
    after = pairs.join(keyed, pairs.submission_id == keyed.owner).select(*columns)
    return R.compare_findings(before, after, ["submission_id"])


@query(
    "U4 D20",
    """WITH pairs AS (SELECT id AS submission_id, parent_submission_id AS parent_id FROM submissions WHERE parent_submission_id IS NOT NULL),
    u AS (SELECT p.submission_id, d.document_type, d.content_hash, -1 AS step FROM pairs p JOIN case_documents d ON d.submission_id = p.parent_id
      UNION ALL SELECT p.submission_id, d.document_type, d.content_hash, 1 FROM pairs p JOIN case_documents d ON d.submission_id = p.submission_id)
    SELECT submission_id, document_type, content_hash, sum(step)::BIGINT AS extra_copies FROM u GROUP BY 1, 2, 3 HAVING sum(step) <> 0""",
)
def document_multiset_changes(t: Tables) -> DataFrame:
    before, after = _sides(t)
    return R.multiset_difference(before, after, ["submission_id"], ["document_type", "content_hash"])


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Documents of the parent and of the submission itself, both dealt by submission: comparing them moves nothing more."""
    pairs = V.version_pairs(t.submissions)
    own = F.col("submission_id").alias("owner")
    return t.documents_for(pairs.withColumnRenamed("parent_id", "owner")), t.documents_for(pairs.select("submission_id", own))


@query(
    "U5 D20",
    """WITH pairs AS (SELECT id AS submission_id, parent_submission_id AS parent_id FROM submissions WHERE parent_submission_id IS NOT NULL),
    d AS (SELECT submission_id, concat(document_type, '.pdf') AS name, content_hash, document_type FROM case_documents),
    a AS (SELECT p.submission_id, name, list(DISTINCT content_hash) AS h FROM pairs p JOIN d ON d.submission_id = p.parent_id GROUP BY 1, 2),
    b AS (SELECT p.submission_id, name, list(DISTINCT content_hash) AS h FROM pairs p JOIN d ON d.submission_id = p.submission_id GROUP BY 1, 2)
    SELECT submission_id, name, len(list_filter(a.h, lambda x: NOT list_contains(b.h, x))) + len(list_filter(b.h, lambda x: NOT list_contains(a.h, x))) AS hash_changes, 0 AS type_changes
    FROM a JOIN b USING (submission_id, name) WHERE list_sort(a.h) <> list_sort(b.h)""",
)
def changed_documents(t: Tables) -> DataFrame:
    before, after = (side.withColumn("filename", F.concat("document_type", F.lit(".PDF"))) for side in _sides(t))
    return R.changed_documents(before, after, ["submission_id"])


@query(
    "J13 X29 F1",
    """WITH m AS (SELECT a.id AS target_id, b.id AS application_id, a.site_address AS ta, b.site_address AS ca,
      row_number() OVER (PARTITION BY a.id ORDER BY b.created_at DESC, b.id DESC) AS rank
      FROM applications a JOIN applications b ON a.id <> b.id AND contains(lower(b.site_address), lower(trim(a.site_address))))
    SELECT target_id, application_id, rank, round_even(200.0 * length(ta) / (length(ta) + length(ca)), 0) / 100 AS similarity FROM m WHERE rank <= 10""",
)
def address_matches(t: Tables) -> DataFrame:
    return L.address_matches(_targets(t), t.applications)


def _targets(t: Tables) -> DataFrame:
    return t.applications.select(F.col("id").alias("target_id"), F.col("site_address").alias("address"), F.array("proposal_description").alias("texts"))


def _postcode_targets(t: Tables) -> DataFrame:
    owners = t.submissions.select(F.col("id").alias("submission_id"), "application_id")
    codes = t.fields.where("field_name = 'postcode'").join(owners, "submission_id")
    best = R.best_fields(codes, "application_id")
    return best.select(F.col("application_id").alias("target_id"), F.col("field_value").alias("postcode"))


_POSTCODES = """pc AS (SELECT DISTINCT s.application_id, upper(replace(f.field_value, ' ', '')) AS k FROM case_fields f JOIN submissions s ON s.id = f.submission_id WHERE f.field_name = 'postcode' AND f.field_value IS NOT NULL),
 tp AS (SELECT s.application_id AS target_id, f.field_value AS postcode FROM case_fields f JOIN submissions s ON s.id = f.submission_id WHERE f.field_name = 'postcode'
   QUALIFY row_number() OVER (PARTITION BY s.application_id ORDER BY coalesce(f.confidence, -1) DESC, f.created_at DESC, f.document_id DESC) = 1),
 pm AS (SELECT target_id, pc.application_id, row_number() OVER (PARTITION BY target_id ORDER BY a.created_at DESC, a.id DESC) AS rank
   FROM tp JOIN pc ON pc.k = upper(replace(tp.postcode, ' ', '')) AND pc.application_id <> tp.target_id JOIN applications a ON a.id = pc.application_id WHERE tp.postcode <> '' QUALIFY rank <= 10)"""


@query("J14 J4 F5", f"WITH {_POSTCODES} SELECT target_id, application_id, rank FROM pm")
def postcode_matches(t: Tables) -> DataFrame:
    return L.postcode_matches(_postcode_targets(t), L.application_postcodes(t.submissions, t.fields), t.applications)


_ADDRESSES = """am AS (SELECT a.id AS target_id, b.id AS application_id, row_number() OVER (PARTITION BY a.id ORDER BY b.created_at DESC, b.id DESC) AS rank,
   round_even(200.0 * length(a.site_address) / (length(a.site_address) + length(b.site_address)), 0) / 100 AS similarity
   FROM applications a JOIN applications b ON a.id <> b.id AND contains(lower(b.site_address), lower(trim(a.site_address))) QUALIFY rank <= 10)"""


@query(
    "D11 U12",
    f"""WITH {_POSTCODES}, {_ADDRESSES} SELECT target_id, application_id, rank, 'address' AS via FROM am
    UNION ALL SELECT target_id, application_id, rank, 'postcode' FROM pm WHERE target_id NOT IN (SELECT target_id FROM am)""",
)
def potential_parents(t: Tables) -> DataFrame:
    postcodes = L.postcode_matches(_postcode_targets(t), L.application_postcodes(t.submissions, t.fields), t.applications)
    return L.potential_parents(_targets(t), L.address_matches(_targets(t), t.applications), postcodes)


@query(
    "D10 X28 F20",
    f"""WITH {_POSTCODES}, ls AS (SELECT application_id, id AS sid FROM submissions QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY created_at DESC, id DESC) = 1),
    rf AS (SELECT a.id AS target_id, ls.sid FROM applications a JOIN applications b ON b.application_ref = nullif(regexp_extract(a.proposal_description, '(?i)APP[-/]?\\d{{4}}[-/]?\\d+', 0), '') JOIN ls ON ls.application_id = b.id),
    ba AS (SELECT a.id AS target_id, b.id AS application_id, round_even(200.0 * length(a.site_address) / (length(a.site_address) + length(b.site_address)), 0) / 100 AS similarity
      FROM applications a JOIN applications b ON a.id <> b.id AND contains(lower(b.site_address), lower(trim(a.site_address)))
      QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY similarity DESC, b.created_at DESC, b.id DESC) = 1),
    ad AS (SELECT target_id, similarity, ls.sid FROM ba JOIN ls USING (application_id) WHERE similarity >= 0.9),
    po AS (SELECT target_id, count(*) AS n, min(application_id) AS application_id FROM pm GROUP BY 1),
    ps AS (SELECT target_id, n, sid FROM po LEFT JOIN ls USING (application_id)),
    r AS (SELECT a.id AS target_id, rf.sid AS rs, ad.sid AS asid, ad.similarity, ps.n, ps.sid AS psid FROM applications a LEFT JOIN rf ON rf.target_id = a.id LEFT JOIN ad ON ad.target_id = a.id LEFT JOIN ps ON ps.target_id = a.id)
    SELECT target_id, coalesce(rs, asid, CASE WHEN n = 1 THEN psid END) AS parent_submission_id,
      CASE WHEN rs IS NOT NULL THEN 0.95 WHEN asid IS NOT NULL THEN similarity WHEN n = 1 AND psid IS NOT NULL THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence,
      CASE WHEN rs IS NOT NULL THEN 'reference' WHEN asid IS NOT NULL THEN 'address' WHEN n = 1 AND psid IS NOT NULL THEN 'postcode' WHEN n > 1 THEN 'several_at_postcode' ELSE 'none' END AS strategy,
      CASE WHEN CASE WHEN rs IS NOT NULL THEN 0.95 WHEN asid IS NOT NULL THEN similarity WHEN n = 1 AND psid IS NOT NULL THEN 0.7 ELSE 0.0 END >= 0.85 THEN 'auto' END AS link_mode FROM r""",
)
def parent_discovery(t: Tables) -> DataFrame:
    postcodes = L.postcode_matches(_postcode_targets(t), L.application_postcodes(t.submissions, t.fields), t.applications)
    closest = L.closest_addresses(_targets(t), t.applications)
    found = L.discover_parents(_targets(t), t.applications, R.latest_submissions(t.submissions), closest, postcodes)
    return found.withColumn("link_mode", L.link_mode(F.col("confidence"), F.lit(None)))


@query(
    "D12 F21",
    """WITH p AS (SELECT a.*, b.id AS pid, b.site_address AS pa, b.application_type AS pu FROM applications a LEFT JOIN applications b ON b.application_ref = nullif(regexp_extract(a.proposal_description, '(?i)APP[-/]?\\d{4}[-/]?\\d+', 0), '') OR (a.id % 6 = 3 AND b.id = a.id - 1)),
    c AS (SELECT id, lower(coalesce(proposal_description, '')) AS d, pid IS NOT NULL AS hp, lower(site_address) AS sa, lower(pa) AS pa, lower(application_type) AS u, lower(pu) AS pu FROM p)
    SELECT id, CASE WHEN NOT hp AND contains(d, 'following refusal') THEN 'resubmission' WHEN NOT hp THEN 'new_construction' WHEN contains(d, 'amendment') THEN 'modification' WHEN sa <> pa THEN 'new_construction' WHEN u <> pu THEN 'new_construction' ELSE 'modification' END AS submission_type,
      CASE WHEN NOT hp THEN 0.6 WHEN contains(d, 'amendment') THEN 0.7 WHEN sa <> pa THEN 0.8 WHEN u <> pu THEN 0.75 ELSE 0.5 END::DOUBLE AS confidence,
      CASE WHEN NOT hp AND contains(d, 'following refusal') THEN 'following refusal' WHEN NOT hp THEN 'no_parent' WHEN contains(d, 'amendment') THEN 'amendment' WHEN sa <> pa THEN concat(sa, ',', pa) WHEN u <> pu THEN concat(u, ',', pu) ELSE 'parent_exists,no_strong_indicators' END AS indicators,
      CASE WHEN NOT hp THEN 0.6 WHEN contains(d, 'amendment') THEN 0.7 WHEN sa <> pa THEN 0.8 WHEN u <> pu THEN 0.75 ELSE 0.5 END < 0.8 AS needs_confirmation FROM c""",
)
def submission_types(t: Tables) -> DataFrame:
    reference = F.coalesce(
        L.parent_reference(F.col("proposal_description")), F.when(F.col("id") % 6 == 3, F.concat(F.lit("APP/2024/"), F.col("id") - 1))
    )
    parents = t.applications.select(
        F.col("application_ref").alias("ref"), F.lit(True).alias("found"), F.col("site_address").alias("parent_address"), F.col("application_type").alias("parent_use")
    )
    joined = t.applications.withColumn("ref", reference).join(parents, "ref", "left")
    kind = L.submission_type(
        F.col("proposal_description"),
        F.col("found").isNotNull(),
        F.col("site_address"),
        F.col("parent_address"),
        F.col("application_type"),
        F.col("parent_use"),
    )
    return joined.select("id", kind.alias("k")).select("id", "k.*", L.needs_confirmation(F.col("k.confidence")).alias("needs_confirmation"))


@query("D15 J6 F18", "SELECT id AS application_id, 'V0' AS submission_version, 'pending' AS status FROM (SELECT id FROM applications UNION ALL SELECT s_suppkey + 1000000000 FROM supplier) WHERE id NOT IN (SELECT application_id FROM submissions)")
def v0_backfill(t: Tables) -> DataFrame:
    """Applications of customers and, filed without a submission, of suppliers."""
    filed = t.raw("supplier").select((F.col("s_suppkey") + 1_000_000_000).cast("long").alias("id"), F.lit(None).cast("timestamp").alias("created_at"))
    every = t.applications.select(F.col("id").cast("long").alias("id"), F.col("created_at").cast("timestamp").alias("created_at")).unionByName(filed)
    return L.v0_backfill(every, t.submissions).select("application_id", "submission_version", "status")


@query(
    "S21 D16 F18",
    """WITH p AS (SELECT document_id, unnest(range(1, page_count + 1)) AS page_number FROM case_documents)
    SELECT document_id, count(*) AS missing_pages, sum(page_number)::BIGINT AS page_sum FROM p WHERE page_number <> 2 GROUP BY 1""",
)
def missing_pages(t: Tables) -> DataFrame:
    from casegrid.sources.layout import saved_pages

    existing = t.documents.where("page_count >= 2").select("document_id", F.lit(2).cast("long").alias("page_number"))
    return saved_pages(t.documents, existing).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("missing_pages"), F.sum("page_number").alias("page_sum")
    )


@query(
    "D27",
    """WITH o AS (SELECT run_id, arg_max(decision, (ts, event_id)) AS document_type FROM review_events WHERE decision <> 'accept' GROUP BY 1)
    SELECT d.document_type AS old_type, coalesce(o.document_type, d.document_type) AS new_type, count(*) AS documents FROM case_documents d LEFT JOIN o ON o.run_id = d.submission_id GROUP BY 1, 2""",
)
def reclassified_documents(t: Tables) -> DataFrame:
    from casegrid.operators.ordered import latest

    stated = latest(t.decisions.where("decision <> 'accept'"), ["run_id"], [F.col("ts"), F.col("event_id")], ["decision"])
    stated = stated.select(F.col("run_id").alias("submission_id"), F.col("decision").alias("stated_type"))
    per_type = t.documents.groupBy("submission_id", "document_type").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_type.join(stated, "submission_id", "left")
        .groupBy(F.col("document_type").alias("old_type"), F.coalesce("stated_type", "document_type").alias("new_type"))
        .agg(F.sum("n").alias("documents"))
    )


@query(
    "D22 K4",
    """SELECT s.id AS submission_id, 'submission' AS section, CAST(s.id AS VARCHAR) AS item, CAST(to_json({'version': s.submission_version, 'status': s.status, 'application_ref': a.application_ref}) AS VARCHAR) AS payload
    FROM submissions s JOIN applications a ON a.id = s.application_id
    UNION ALL SELECT submission_id, 'document', document_id, CAST(to_json({'filename': filename, 'document_type': document_type}) AS VARCHAR) FROM case_documents
    UNION ALL SELECT submission_id, 'check', check_id, CAST(to_json({'rule_id': rule_id, 'status': status, 'message': explanation}) AS VARCHAR) FROM case_checks
    UNION ALL SELECT submission_id, 'summary', CAST(submission_id AS VARCHAR), CAST(to_json({'pass': count(*) FILTER (status = 'pass'), 'fail': count(*) FILTER (status = 'fail'), 'needs_review': count(*) FILTER (status = 'needs_review')}) AS VARCHAR) FROM case_checks GROUP BY submission_id""",
)
def decision_package(t: Tables) -> DataFrame:
    from casegrid.sources.sinks import decision_package as package

    return package(t.submissions, t.applications, t.documents, t.checks)
