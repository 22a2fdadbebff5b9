"""The case tables of `bridge.py` stated as SQL over the supplied tables, for result checks in a SQL database."""

_LINE_ID = "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)"
_DOC_TYPE = (
    "CASE l_linenumber WHEN 1 THEN 'application_form' WHEN 2 THEN 'location_plan' WHEN 3 THEN 'site_plan' "
    "WHEN 4 THEN 'floor_plan' WHEN 5 THEN 'elevation' WHEN 6 THEN 'design_statement' ELSE 'heritage_statement' END"
)
_FIELD_TAIL = (
    "CASE WHEN l_linenumber <> 7 THEN round(1 - l_discount, 2) END AS confidence, "
    "CASE l_returnflag WHEN 'R' THEN 'regex' WHEN 'A' THEN 'heuristic' ELSE 'label' END AS extractor, "
    "l_shipdate AS created_at FROM lineitem"
)


def _field(name: str, value: str, unit: str) -> str:
    return (
        f"SELECT l_orderkey AS submission_id, {_LINE_ID} AS document_id, '{name}' AS field_name, "
        f"{value} AS field_value, {unit} AS field_unit, {_FIELD_TAIL}"
    )


VIEWS: dict[str, str] = {
    "applications": """
        SELECT c_custkey AS id, concat('APP/2024/', c_custkey) AS application_ref,
          CASE WHEN c_custkey % 40 = 7 THEN NULL ELSE c_name END AS applicant_name,
          concat(c_nationkey + 1, ' ', c_mktsegment, ' ROAD',
            CASE WHEN c_custkey % 4 <> 0 THEN concat(', WARD ', c_custkey % 7) ELSE '' END) AS site_address,
          CASE c_custkey % 6 WHEN 0 THEN concat('Amendment to APP/2024/', c_custkey + 1)
            WHEN 1 THEN 'Rear extension to dwelling' WHEN 2 THEN 'New dwelling following refusal'
            WHEN 3 THEN 'Change of use' WHEN 4 THEN '' END AS proposal_description,
          CASE c_mktsegment WHEN 'BUILDING' THEN 'full_planning' WHEN 'HOUSEHOLD' THEN 'householder'
            WHEN 'MACHINERY' THEN 'prior_approval' WHEN 'FURNITURE' THEN 'listed_building'
            ELSE 'major_application' END AS application_type,
          CASE WHEN c_acctbal < 0 THEN 'in_review' WHEN c_acctbal < 5000 THEN 'open' ELSE 'closed' END AS status,
          TIMESTAMP '2023-01-01 00:00:00'
            + to_days(CAST(((CAST(floor(c_acctbal) AS BIGINT) % 365) + 365) % 365 AS INTEGER)) AS created_at
        FROM customer""",
    "submissions": """
        SELECT o_orderkey AS id, o_custkey AS application_id,
          concat('V', row_number() OVER w - 1) AS submission_version,
          lag(o_orderkey) OVER w AS parent_submission_id,
          CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'needs_info' END AS status,
          o_orderdate AS created_at, o_orderpriority AS priority, o_totalprice AS total_price,
          row_number() OVER w - 1 AS version_no
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "case_documents": f"""
        SELECT {_LINE_ID} AS document_id, l_orderkey AS submission_id,
          concat({_DOC_TYPE}, '_', l_partkey, '.pdf') AS filename, {_DOC_TYPE} AS document_type,
          sha256(CAST(l_partkey AS VARCHAR)) AS content_hash, CAST(l_linenumber + 1 AS BIGINT) AS page_count,
          l_shipdate AS uploaded_at, concat('azure://store/', l_linestatus, '/', {_LINE_ID}) AS blob_uri
        FROM lineitem""",
    "case_fields": " UNION ALL ".join(
        [
            _field("floor_area", "CAST(l_quantity AS VARCHAR)", "'sqm'"),
            _field("ridge_height", "CAST(round(l_tax * 100, 1) AS VARCHAR)", "'m'"),
            _field("boundary_distance", "CAST(round(l_discount * 100, 1) AS VARCHAR)", "'m'"),
            _field("site_address", "CASE WHEN l_linenumber = 5 THEN '' ELSE concat(l_suppkey % 5 + 1, ' High Street') END", "NULL"),
            _field("postcode", "CASE WHEN l_linenumber <> 6 THEN concat('B', l_suppkey % 3 + 1, ' ', l_partkey % 2 + 1, 'AB') END", "NULL"),
            _field("application_ref", "concat('APP/2024/', l_orderkey)", "NULL"),
        ]
    ),
    "case_pages": "SELECT submission_id, document_id, unnest(range(1, page_count + 1)) AS page_number FROM case_documents",
    "case_evidence": """
        SELECT submission_id, document_id, field_name,
          CASE field_name WHEN 'floor_area' THEN CAST(split_part(document_id, '-', 2) AS BIGINT) % 2 + 1
            WHEN 'ridge_height' THEN CAST(split_part(document_id, '-', 3) AS BIGINT) % 2 + 1
            WHEN 'boundary_distance' THEN 99 WHEN 'site_address' THEN 1 ELSE 2 END AS page_number
        FROM case_fields WHERE field_name <> 'application_ref'""",
    "case_checks": f"""
        SELECT {_LINE_ID} AS check_id, l_orderkey AS submission_id, {_LINE_ID} AS document_id,
          CASE l_linenumber WHEN 1 THEN 'R1' WHEN 2 THEN 'R2' WHEN 3 THEN 'R3' WHEN 4 THEN 'R4' WHEN 5 THEN 'R5'
            WHEN 6 THEN 'R-DOC-001' ELSE 'R-DOC-002' END AS rule_id,
          CASE l_returnflag WHEN 'R' THEN 'fail' WHEN 'A' THEN 'needs_review' ELSE 'pass' END AS status,
          CASE l_returnflag WHEN 'R' THEN 'Missing required fields: site_address, proposed_use'
            WHEN 'A' THEN 'Inconsistent postcode' ELSE 'All required fields present.' END AS explanation,
          CASE WHEN l_linenumber <= 4 THEN 'error' ELSE 'warning' END AS severity, l_shipdate AS created_at
        FROM lineitem""",
    "case_features": f"""
        SELECT {_LINE_ID} AS feature_id, l_orderkey AS submission_id,
          CASE l_suppkey % 3 WHEN 0 THEN 'boundary_fence' WHEN 1 THEN 'rear_extension' ELSE 'main_building' END AS feature_type
        FROM lineitem""",
    "case_metrics": f"""
        SELECT {_LINE_ID} AS feature_id,
          CASE l_linenumber % 3 WHEN 0 THEN 'setback_distance' WHEN 1 THEN 'ridge_height' ELSE 'floor_area' END AS metric_name,
          l_quantity / 2 AS metric_value, CASE l_linenumber % 3 WHEN 2 THEN 'sqm' ELSE 'm' END AS metric_unit
        FROM lineitem""",
    "case_runs": """
        SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_custkey END AS application_id,
          concat(o_orderkey, '-direct') AS document_id,
          CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
          o_orderdate AS started_at,
          CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_hours(CAST(o_orderkey % 7 AS INTEGER)) END AS completed_at,
          concat('{"application_ref":"APP/2024/', o_custkey, '","progress":{"current":', o_orderkey % 5,
            '},"summary":{"successes":', o_orderkey % 3, ',"failures":', o_orderkey % 2, '}}') AS run_metadata
        FROM orders""",
    "case_run_documents": f"SELECT l_orderkey AS run_id, {_LINE_ID} AS document_id FROM lineitem",
    "issue_actions": """
        SELECT event_id AS action_id, user_id AS issue_id, ts,
          CASE event_type WHEN 'click' THEN 'document_upload' WHEN 'view' THEN 'option_selection'
            WHEN 'signup' THEN 'explanation_provided' WHEN 'error' THEN 'dismissed' ELSE 'recheck' END AS action_type,
          CASE WHEN event_type = 'purchase' THEN CASE WHEN value > 20 THEN 'resolved' ELSE 'open' END END AS new_status
        FROM events""",
    "review_events": """
        SELECT event_id, user_id AS run_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS check_no,
          CASE event_type WHEN 'click' THEN 'accept' WHEN 'purchase' THEN 'accept' WHEN 'view' THEN 'reject'
            ELSE 'need_info' END AS decision, ts
        FROM events""",
    "alert_events": """
        SELECT event_id AS alert_id, ts, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'error'
          WHEN 'signup' THEN 'warning' WHEN 'click' THEN 'info' ELSE 'debug' END AS severity
        FROM events""",
    "usage_calls": r"""
        SELECT conv_id, turn,
          CASE conv_id % 4 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'my-GPT-4o-mini' WHEN 2 THEN 'text-embedding-3-small'
            ELSE 'local-model' END AS model,
          role AS operation, CAST(len(regexp_split_to_array(trim(text), '[ \t\n\r\f]+')) AS BIGINT) AS input_tokens,
          CAST(length(text) AS BIGINT) AS output_tokens
        FROM conversations""",
    "layout_lines": """
        SELECT doc_id, lang, source, list_concat(list_filter([
          CASE doc_id % 6 WHEN 0 THEN 'Application Form: householder planning application'
            WHEN 1 THEN 'Statement of display of a site notice' WHEN 2 THEN 'Site plan scale 1:500 @ A3'
            WHEN 3 THEN 'Proposed floor plan' WHEN 4 THEN 'Design and Access Statement' ELSE 'Covering letter' END,
          CASE WHEN doc_id % 3 <> 2 THEN concat('Our ref PP-', 10000000 + doc_id) END,
          CASE WHEN doc_id % 2 = 0 THEN 'Site location' END,
          CASE WHEN doc_id % 4 = 0 THEN concat('Property Name: Unit ', doc_id % 26) END,
          concat('Address Line 1: ', doc_id % 200 + 1, ' Dorset Road'),
          CASE WHEN doc_id % 3 = 0 THEN 'Town/City: Saltley' END,
          CASE WHEN doc_id % 5 <> 4 THEN concat('Postcode: B', doc_id % 20 + 1, ' ', doc_id % 9 + 1, 'AB') END,
          CASE WHEN doc_id % 7 = 0 THEN 'City council PO Box 28 B1 1TU planning@example.org' END,
          concat('Ridge height ', doc_id % 10 + 4, '.5 m above ground level for proposed extension'),
          concat('Site area ', n_chars % 900 + 10, CASE doc_id % 3 WHEN 0 THEN ' sqm' WHEN 1 THEN ' ha' ELSE ' acres' END),
          concat('bedroom 1 floor area ', doc_id % 15 + 5, '.25 m2'),
          CASE doc_id % 4 WHEN 0 THEN 'Certificate A ownership' WHEN 1 THEN 'I certify that notice has been given'
            WHEN 2 THEN 'Signed by: Jane Smith 12/03/2024' END,
          CASE doc_id % 3 WHEN 0 THEN concat('Fee paid £', doc_id % 400 + 20, '.00') WHEN 1 THEN 'Fee exemption claimed' END,
          CASE WHEN doc_id % 6 = 2 THEN 'North arrow' END,
          CASE WHEN doc_id % 6 = 2 THEN concat('Drawing No: P', doc_id, ' Rev: B') END,
          CASE WHEN doc_id % 6 = 2 THEN '0 5 10 m' END,
          concat('Applicant name: Person ', doc_id),
          CASE doc_id % 8 WHEN 1 THEN 'THE PROPOSED CONVERSION OF A DWELLING TO HMO USE.'
            WHEN 2 THEN concat('I/We hereby apply for prior approval: change of use of offices to dwelling ', doc_id) END,
          concat('applicant email user', doc_id, '@example.com tel 0121 555 ', lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0'))
          ], lambda x: x IS NOT NULL), string_split(text, chr(10))) AS lines
        FROM documents""",
    "raw_blocks": """
        SELECT doc_id, lang, source, unnest(lines) AS content, generate_subscripts(lines, 1) - 1 AS idx FROM layout_lines""",
    "layout_blocks": r"""
        SELECT doc_id, lang, source, content, CAST(idx AS BIGINT) AS idx, CAST(idx // 10 + 1 AS BIGINT) AS page_number,
          CASE WHEN idx = 0 THEN 'title' WHEN idx % 10 = 5 THEN 'sectionHeading' END AS role,
          trim(regexp_replace(content, '[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS norm
        FROM raw_blocks""",
    "graph_entities": """
        SELECT p_brand AS app_id, concat('e', p_partkey) AS id, p_partkey AS ord,
          concat(upper(p_name), CASE p_size % 4 WHEN 0 THEN ' AREA ' WHEN 1 THEN ' HEIGHT ' WHEN 2 THEN ' WALL ' ELSE ' ' END, p_partkey % 20) AS title,
          CASE p_size % 6 WHEN 0 THEN 'Room' WHEN 1 THEN 'building' WHEN 2 THEN 'boundary' WHEN 3 THEN 'measurement'
            WHEN 4 THEN 'Measurement' ELSE 'thing' END AS type,
          concat('form says ', p_size, ' sqm; drawing says ', p_partkey % 9 + p_size, '.5 m2 and ', p_partkey % 4 + 2, ' metres') AS description,
          [concat('tu', p_partkey % 97), concat('tu', p_partkey % 31)] AS text_unit_ids
        FROM part""",
    "graph_text_units": "SELECT concat('tu', doc_id) AS id, CAST(doc_id AS VARCHAR) AS document_id FROM documents",
    "graph_documents": """
        SELECT CAST(doc_id AS VARCHAR) AS id, concat(CASE doc_id % 4 WHEN 0 THEN 'application_form_'
          WHEN 1 THEN 'planning_statement_' WHEN 2 THEN 'floor_drawing_' ELSE 'letter_' END, doc_id, '.pdf') AS title
        FROM documents""",
    "graph_relationships": """
        SELECT s.app_id, l_orderkey * 8 + l_linenumber AS ord, l_partkey * 100000 + l_suppkey AS ord2,
          s.title AS source, lower(t.title) AS target,
          CASE l_linenumber WHEN 1 THEN 'adjacent_to' WHEN 2 THEN 'contains' ELSE '' END AS type,
          CASE l_linenumber WHEN 3 THEN 'door between' WHEN 4 THEN 'total area of' WHEN 5 THEN 'garden fence'
            WHEN 6 THEN 'source evidence' ELSE 'located near' END AS description,
          l_quantity AS weight
        FROM lineitem JOIN graph_entities s ON s.ord = l_partkey JOIN graph_entities t ON t.ord = l_suppkey""",
    "case_claims": """
        SELECT submission_id AS app_id, concat('f:', document_id, ':', field_name) AS node_id, field_name,
          coalesce(field_value, '') AS field_value, field_unit, 'form' AS source FROM case_fields
        UNION ALL
        SELECT f.submission_id, concat('g:', f.feature_id), m.metric_name, CAST(m.metric_value AS VARCHAR), m.metric_unit,
          'geometry' FROM case_features f JOIN case_metrics m USING (feature_id)""",
}
