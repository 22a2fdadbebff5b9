"""Graph, conflict, community, evaluation and robustness queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.operators import community as C
from casegrid.operators import conflicts as X
from casegrid.operators import evaluate as M
from casegrid.operators import graph as G
from casegrid.operators import matching as O
from casegrid.plans.bridge import Tables
from casegrid.plans.registry import query
from casegrid.session import cut_lineage

_KEYWORDS = " ".join(f"WHEN contains(lower(title), '{k}') THEN '{v}'" for k, v in G.NAME_KEYWORDS)
_NODE_TYPE = f"CASE lower(trim(type)) WHEN 'room' THEN 'Room' WHEN 'building' THEN 'Building' WHEN 'boundary' THEN 'Boundary' WHEN 'measurement' THEN 'Measurement' ELSE CASE {_KEYWORDS} ELSE 'Building' END END"


def _words(col: str, classes: list, default: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains({col}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in classes)
    return f"CASE {whens} ELSE '{default}' END"


_GRAPH = f"""
 units AS (SELECT u.id AS tu, coalesce(d.title, u.document_id) AS title, {_words("lower(coalesce(d.title, u.document_id))", G.SOURCE_WORDS, "document")} AS source FROM graph_text_units u LEFT JOIN graph_documents d ON d.id = u.document_id),
 spread AS (SELECT app_id, id, unnest(text_unit_ids) AS tu, generate_subscripts(text_unit_ids, 1) AS n FROM graph_entities),
 src AS (SELECT app_id, id, arg_min(source, n) AS source, array_to_string(list_sort(list(DISTINCT title)), ',') AS titles FROM spread JOIN units USING (tu) GROUP BY 1, 2),
 gnodes AS (SELECT e.app_id, concat(lower({_NODE_TYPE}), '_', e.id) AS node_id, {_NODE_TYPE} AS node_type, trim(e.title) AS label, e.id AS entity_id, e.ord, coalesce(s.source, 'unknown') AS source, s.titles, e.description
   FROM graph_entities e LEFT JOIN src s ON s.app_id = e.app_id AND s.id = e.id WHERE {_NODE_TYPE} <> 'Measurement'),
 named AS (SELECT app_id, lower(label) AS name, arg_min(node_id, (ord, node_id)) AS node_id FROM gnodes GROUP BY 1, 2),
 rel AS (SELECT r.app_id, s.node_id AS src, d.node_id AS dst, CASE type WHEN 'adjacent_to' THEN 'ADJACENT_TO' WHEN 'contains' THEN 'CONTAINS' ELSE {_words("lower(description)", G.DESCRIPTION_WORDS, "CONTAINS")} END AS edge_type, weight, r.ord, r.ord2
   FROM graph_relationships r JOIN named s ON s.app_id = r.app_id AND s.name = lower(trim(r.source)) JOIN named d ON d.app_id = r.app_id AND d.name = lower(trim(r.target))),
 gedges AS (SELECT app_id, src, dst, edge_type, weight FROM rel QUALIFY row_number() OVER (PARTITION BY app_id, src, dst ORDER BY ord DESC, ord2 DESC, edge_type DESC, weight DESC) = 1)
"""


def _units(t: Tables) -> DataFrame:
    return G.text_unit_sources(t.text_units, t.source_documents)


def _nodes(t: Tables) -> DataFrame:
    return G.entity_nodes(t.entities, _units(t))


def _edges(t: Tables, nodes: DataFrame) -> DataFrame:
    return G.relationship_edges(nodes, t.relationships)


@query("A1 J16 J17 X19", f"WITH {_GRAPH} SELECT app_id, node_id, node_type, label, source, titles FROM gnodes")
def graph_nodes(t: Tables) -> DataFrame:
    return _nodes(t).select("app_id", "node_id", "node_type", "label", "source", F.array_join("doc_titles", ",").alias("titles"))


@query("A2 A5 J15", f"WITH {_GRAPH} SELECT * FROM gedges")
def graph_edges(t: Tables) -> DataFrame:
    return _edges(t, _nodes(t))


_M1, _M2 = r"(\d+\.?\d*)\s*(sqm|sq\s*m|m²|m2)", r"(\d+\.?\d*)\s*(square\s*metres?|square\s*meters?)"


@query(
    "A3 X13 X14 X10",
    """WITH e AS (SELECT *, CAST(regexp_extract(description, 'says (\\d+) sqm', 1) AS DOUBLE) AS v1, CAST(regexp_extract(description, 'says ([0-9.]+) m2', 1) AS DOUBLE) AS v2,
        CAST(regexp_extract(description, 'and (\\d+) metres', 1) AS DOUBLE) AS v3 FROM graph_entities WHERE lower(type) = 'measurement'),
    v AS (SELECT app_id, id, title, 0 AS n, v1 AS v, 'sqm' AS u FROM e UNION ALL SELECT app_id, id, title, 1, v2, 'sqm' FROM e WHERE v2 <> v1
      UNION ALL SELECT app_id, id, title, CASE WHEN v2 = v1 THEN 1 ELSE 2 END, v3, 'm' FROM e WHERE v3 <> v1 AND v3 <> v2)
    SELECT app_id, concat('claim_', id, '_', n) AS node_id, trim(regexp_replace(lower(trim(title)), '[^a-z0-9]+', '_', 'g'), '_') AS field_name, CAST(v AS VARCHAR) AS field_value, u AS field_unit FROM v""",
)
def measurement_claims(t: Tables) -> DataFrame:
    return G.measurement_claims(t.entities, _units(t)).select("app_id", "node_id", "field_name", "field_value", "field_unit")


@query(
    "F14 F15 F16 G29",
    f"""WITH {_GRAPH}, sp AS (SELECT * FROM gnodes WHERE node_type IN ('Room', 'Building', 'Boundary', 'Opening')),
    se AS (SELECT e.* FROM gedges e WHERE (app_id, src) IN (SELECT app_id, node_id FROM sp) AND (app_id, dst) IN (SELECT app_id, node_id FROM sp)),
    ae AS (SELECT * FROM gedges WHERE edge_type = 'ADJACENT_TO'), an AS (SELECT DISTINCT app_id, n FROM (SELECT app_id, src AS n FROM ae UNION ALL SELECT app_id, dst FROM ae))
    SELECT 'spatial_nodes' AS part, app_id, count(*) AS n FROM sp GROUP BY 2 UNION ALL SELECT 'spatial_edges', app_id, count(*) FROM se GROUP BY 2
    UNION ALL SELECT 'adjacent_edges', app_id, count(*) FROM ae GROUP BY 2 UNION ALL SELECT 'adjacent_nodes', app_id, count(*) FROM an GROUP BY 2""",
)
def subgraph_sizes(t: Tables) -> DataFrame:
    nodes = _nodes(t)
    edges = _edges(t, nodes)
    spatial_nodes, spatial_edges = G.spatial(nodes, edges)
    adjacent_nodes, adjacent_edges = G.by_edge_type(nodes, edges, ["ADJACENT_TO"])
    parts = {"spatial_nodes": spatial_nodes, "spatial_edges": spatial_edges, "adjacent_edges": adjacent_edges, "adjacent_nodes": adjacent_nodes}
    counted = [df.groupBy("app_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "app_id", "n") for name, df in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


@query(
    "F17",
    f"""WITH {_GRAPH}, seeds AS (SELECT app_id, node_id FROM gnodes WHERE contains(lower(coalesce(titles, '')), 'statement_1') OR contains(lower(concat_ws(' ', source, description, label)), 'statement_1')),
    around AS (SELECT app_id, node_id FROM seeds UNION SELECT e.app_id, e.dst FROM gedges e JOIN seeds s ON s.app_id = e.app_id AND s.node_id = e.src UNION SELECT e.app_id, e.src FROM gedges e JOIN seeds s ON s.app_id = e.app_id AND s.node_id = e.dst)
    SELECT a.app_id, a.node_id FROM around a JOIN gnodes g ON g.app_id = a.app_id AND g.node_id = a.node_id""",
)
def application_subgraph(t: Tables) -> DataFrame:
    nodes = _nodes(t)
    kept, _ = G.mentioning(nodes, _edges(t, nodes), "statement_1")
    return kept.select("app_id", "node_id")


@query(
    "G29 A4",
    f"""WITH RECURSIVE {_GRAPH}, narrow AS (SELECT * FROM gedges),
    links AS (SELECT app_id, src AS a, dst AS b FROM narrow UNION SELECT app_id, dst, src FROM narrow),
    reach(app_id, node_id, seen) AS (SELECT app_id, node_id, node_id FROM gnodes UNION SELECT r.app_id, r.node_id, l.b FROM reach r JOIN links l ON l.app_id = r.app_id AND l.a = r.seen),
    comp AS (SELECT app_id, node_id, min(seen) AS c FROM reach GROUP BY 1, 2),
    n AS (SELECT app_id, count(*) AS total_nodes, count(DISTINCT c) AS components FROM comp GROUP BY 1), m AS (SELECT app_id, count(*) AS total_edges FROM narrow GROUP BY 1)
    SELECT app_id, total_nodes, coalesce(total_edges, 0) AS total_edges, round(coalesce(total_edges, 0) / (total_nodes * (total_nodes - 1)), 8) AS density, components, components = 1 AS connected FROM n LEFT JOIN m USING (app_id)""",
)
def graph_summary(t: Tables) -> DataFrame:
    """Counts, density and components of each whole graph: its ends are worked out once and read many times."""
    found = _nodes(t)
    nodes = cut_lineage(found.select("app_id", "node_id"))
    edges = cut_lineage(_edges(t, found).select("app_id", "src", "dst"))
    return G.graph_summary(nodes, edges, G.components(nodes, edges))


_BRUTE = """
 c0 AS (SELECT app_id, node_id, field_name, field_value, field_unit, source, TRY_CAST(regexp_replace(field_value, '[^\\d.\\-]', '', 'g') AS DOUBLE) AS num, lower(trim(field_value)) AS norm FROM case_claims),
 c AS (SELECT *, lower(field_name) AS fn FROM c0),
 pairs AS (SELECT a.app_id, a.field_name, a.node_id AS ia, b.node_id AS ib, a.field_value AS va, b.field_value AS vb, a.num AS na, b.num AS nb, a.norm AS oa, b.norm AS ob, a.field_unit AS unit
   FROM c a JOIN c b ON a.app_id = b.app_id AND a.field_name = b.field_name AND a.node_id < b.node_id WHERE a.field_value <> b.field_value
   UNION ALL SELECT a.app_id, a.field_name, a.node_id, b.node_id, a.field_value, b.field_value, a.num, b.num, a.norm, b.norm, coalesce(a.field_unit, b.field_unit)
   FROM c a JOIN c b ON a.app_id = b.app_id AND a.source <> 'geometry' AND b.source = 'geometry' AND a.field_value <> b.field_value AND (a.fn = b.fn
     OR (regexp_matches(a.fn, 'area|sqm') AND regexp_matches(b.fn, 'area|sqm')) OR (regexp_matches(a.fn, 'height|ridge|eaves') AND regexp_matches(b.fn, 'height|ridge|eaves'))
     OR (regexp_matches(a.fn, 'distance|boundary|setback|separation') AND regexp_matches(b.fn, 'distance|boundary|setback|separation')))),
 typed AS (SELECT *, CASE WHEN regexp_matches(lower(field_name), 'area|sqm') THEN 'area' WHEN regexp_matches(lower(field_name), 'height|ridge|eaves') THEN 'height' WHEN regexp_matches(lower(field_name), 'distance|boundary|setback') THEN 'distance' WHEN contains(lower(field_name), 'address') THEN 'address' ELSE 'value' END AS kind,
   CASE WHEN na IS NOT NULL AND nb IS NOT NULL THEN abs(na - nb) END AS diff, CASE WHEN na IS NOT NULL AND nb IS NOT NULL THEN abs(na - nb) / greatest(abs(na), abs(nb), 1e-9) END AS pct FROM pairs),
 hits AS (SELECT *, regexp_replace(lower(field_name), '_(area|height|width|depth|length|distance|dimensions|setback|separation|sqm|value)$', '') AS base FROM typed
   WHERE CASE WHEN pct IS NULL THEN oa <> ob ELSE pct > CASE kind WHEN 'height' THEN 0.15 / greatest(abs(na), abs(nb), 1e-9) WHEN 'distance' THEN 0.10 / greatest(abs(na), abs(nb), 1e-9) ELSE 0.10 END END),
 worst AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY app_id, base, kind ORDER BY coalesce(pct, 0) DESC, coalesce(diff, 0) DESC, ia, ib, field_name) = 1)
"""


@query(
    "A8 A9 J11 J12 W15 W16 X15 X16 X17 X18",
    f"""WITH {_BRUTE} SELECT app_id, base AS base_entity, kind AS conflict_type, field_name, round(diff, 6) AS discrepancy, round(pct, 6) AS discrepancy_pct,
      CASE WHEN pct IS NULL THEN 'medium' WHEN pct > 0.25 THEN 'high' WHEN pct > 0.10 THEN 'medium' ELSE 'low' END AS severity,
      concat('conflict_', row_number() OVER (PARTITION BY app_id ORDER BY base, kind)) AS conflict_id FROM worst""",
)
def conflicts(t: Tables) -> DataFrame:
    """The checked side compares every pair; this side never forms them."""
    found = X.detect_conflicts(t.by_submission.claims)
    return found.select(
        "app_id",
        "base_entity",
        "conflict_type",
        "field_name",
        F.round("discrepancy", 6).alias("discrepancy"),
        F.round("discrepancy_pct", 6).alias("discrepancy_pct"),
        "severity",
        "conflict_id",
    )


@query(
    "A10 A11 G30",
    f"""WITH {_BRUTE}, s AS (SELECT kind, CASE WHEN pct IS NULL THEN 'medium' WHEN pct > 0.25 THEN 'high' WHEN pct > 0.10 THEN 'medium' ELSE 'low' END AS sev FROM worst)
    SELECT 'type' AS by, kind AS name, count(*) AS conflicts FROM s GROUP BY 2 UNION ALL SELECT 'severity', sev, count(*) FROM s GROUP BY 2""",
)
def conflict_summary(t: Tables) -> DataFrame:
    found = X.detect_conflicts(t.by_submission.claims)
    nodes = t.by_submission.claims.select("app_id", "node_id")
    none = nodes.where("false").select("app_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit("CONTAINS").alias("edge_type"))
    edges = X.contradiction_edges(found, nodes, none)
    return X.conflict_summary(X.listed_contradictions(edges))


@query(
    "A10",
    f"""WITH {_BRUTE} SELECT 'CONTRADICTS' AS edge_type, 2 * count(*) AS edges FROM worst UNION ALL SELECT 'NOTES', count(*) FROM case_claims WHERE field_name = 'postcode'""",
)
def contradictions_replace_edges(t: Tables) -> DataFrame:
    """Support between two claims gives way to their contradiction; edges between other nodes stay."""
    claims = t.by_submission.claims
    found = cut_lineage(X.detect_conflicts(claims).select("app_id", "claim_a_id", "claim_b_id", "conflict_id", "conflict_type", "field_name", "severity"))
    support = found.repartition("app_id").select("app_id", F.col("claim_a_id").alias("src"), F.col("claim_b_id").alias("dst"), F.lit("SUPPORTS").alias("edge_type"))
    notes = claims.where("field_name = 'postcode'").select("app_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit("NOTES").alias("edge_type"))
    edges = X.contradiction_edges(found, claims.select("app_id", "node_id"), support.distinct().unionByName(notes))
    return edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"))


def _case_graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    s = t.by_submission
    return G.case_graph(s.documents, s.pages, s.evidenced_fields, t.by_document.evidence, s.features, t.metrics)


@query(
    "A6 X20",
    """WITH e AS (SELECT DISTINCT submission_id, field_name FROM case_fields WHERE field_name IN ('floor_area', 'ridge_height', 'boundary_distance')),
    n AS (SELECT submission_id, 'PlanningDocument' AS node_type FROM case_documents UNION ALL SELECT submission_id, 'Page' FROM case_pages UNION ALL SELECT submission_id, CASE field_name WHEN 'floor_area' THEN 'Room' WHEN 'ridge_height' THEN 'Building' ELSE 'Boundary' END FROM e
      UNION ALL SELECT submission_id, 'Claim' FROM case_fields UNION ALL SELECT submission_id, CASE feature_type WHEN 'boundary_fence' THEN 'Boundary' WHEN 'rear_extension' THEN 'Room' ELSE 'Building' END FROM case_features
      UNION ALL SELECT f.submission_id, 'Claim' FROM case_features f JOIN case_metrics USING (feature_id))
    SELECT submission_id AS app_id, node_type, count(*) AS nodes, count(*) AS distinct_ids FROM n GROUP BY 1, 2""",
)
def case_graph_nodes(t: Tables) -> DataFrame:
    nodes, _ = _case_graph(t)
    return nodes.groupBy("app_id", "node_type").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("node_id").alias("distinct_ids"))


_FIRST_FIELDS = """first AS (SELECT submission_id, field_name, min(document_id) AS document_id FROM case_fields WHERE field_name IN ('floor_area', 'ridge_height', 'boundary_distance') GROUP BY 1, 2),
    placed AS (SELECT f.submission_id, f.field_name, concat('page:', p.document_id, ':', p.page_number) AS page FROM first f JOIN case_evidence e USING (submission_id, document_id, field_name)
      JOIN case_pages p ON p.document_id = e.document_id AND p.page_number = e.page_number)"""


@query(
    "A6 J18",
    f"""WITH {_FIRST_FIELDS},
    x AS (SELECT submission_id, concat('page:', p.document_id, ':', p.page_number) AS page, 'CONTAINS' AS edge_type, 'doc' AS kind FROM case_pages p
      UNION ALL SELECT submission_id, page, 'EXTRACTED_FROM', 'entity' FROM placed
      UNION ALL SELECT e.submission_id, concat('page:', p.document_id, ':', p.page_number), 'EXTRACTED_FROM', 'claim' FROM case_evidence e JOIN case_pages p ON p.document_id = e.document_id AND p.page_number = e.page_number)
    SELECT submission_id AS app_id, page, edge_type, kind, count(*) AS edges FROM x GROUP BY 1, 2, 3, 4""",
)
def case_page_links(t: Tables) -> DataFrame:
    """What hangs on each page: its document, the claims its evidence shows, and entities through their first field."""
    _, edges = _case_graph(t)
    kind = F.split("src", ":")[0]
    return edges.where(F.col("dst").startswith("page:")).groupBy("app_id", F.col("dst").alias("page"), "edge_type", kind.alias("kind")).agg(F.count(F.lit(1)).alias("edges"))


@query(
    "A7 A6",
    f"""WITH {_FIRST_FIELDS}
    SELECT submission_id AS app_id, page, CAST(count(*) FILTER (field_name <> 'boundary_distance') * (count(*) FILTER (field_name <> 'boundary_distance') - 1) / 2 AS BIGINT) AS adjacent_pairs, 0 AS opens_into_pairs
    FROM placed GROUP BY 1, 2""",
)
def implied_page_edges(t: Tables) -> DataFrame:
    """Room and building of a submission are adjacent where the evidence of their first fields names one page."""
    nodes, edges = _case_graph(t)
    return G.clique_counts(G.page_cliques(nodes, edges), edges)


def _spatial_part(t: Tables, resolutions: list[float]) -> tuple[DataFrame, DataFrame]:
    nodes = _nodes(t)
    kept, edges = G.spatial(nodes, _edges(t, nodes))
    strong = edges.where("edge_type IN ('ADJACENT_TO', 'OPENS_INTO', 'CONTAINS')")
    return C.with_resolutions(kept.select("app_id", "node_id", "node_type"), resolutions), C.with_resolutions(
        strong.select("app_id", "src", "dst", F.lit(1.0).alias("weight")), resolutions
    )


@query("A12 A13 A14")
def community_quality(t: Tables) -> DataFrame:
    """Communities at two resolutions: their number and modularity per application."""
    nodes, edges = _spatial_part(t, [0.5, 1.0])
    labels = C.detect(nodes, edges, levels=1)
    links = C._links(edges.where(F.col("src") != F.col("dst")))
    degree = links.groupBy("app_id", "gamma", F.col("src").alias("node_id")).agg(F.sum("weight").alias("k"))
    quality = C.modularity(links, nodes.join(degree, ["app_id", "gamma", "node_id"], "left").fillna(0.0, ["k"]).select("app_id", "gamma", "node_id", "k"), labels)
    counts = labels.groupBy("app_id", "gamma").agg(F.count_distinct("label").alias("communities"), F.count(F.lit(1)).alias("nodes"))
    return counts.join(quality, ["app_id", "gamma"]).withColumn("modularity", F.round("modularity", 6))


_COMMUNITY = f"""{_GRAPH}, sp AS (SELECT *, CAST(ord % 12 AS VARCHAR) AS cl FROM gnodes WHERE node_type IN ('Room', 'Building', 'Boundary', 'Opening')),
 l AS (SELECT app_id, node_id, node_type, cl FROM sp),
 x AS (SELECT e.app_id, a.cl AS ca, b.cl AS cb, a.node_type = 'Room' AND b.node_type = 'Room' AS rr FROM gedges e JOIN l a ON a.app_id = e.app_id AND a.node_id = e.src JOIN l b ON b.app_id = e.app_id AND b.node_id = e.dst),
 touch AS (SELECT app_id, ca AS cl, ca = cb AS inn, ca = cb AND rr AS rl FROM x UNION ALL SELECT app_id, cb, false, false FROM x WHERE ca <> cb),
 prof AS (SELECT s.app_id, s.cl AS label, s.n AS node_count, s.rooms, round(CASE WHEN s.n < 2 THEN 1.0 WHEN coalesce(t.e, 0) = 0 THEN 0.0 ELSE t.i / t.e END, 8)::DOUBLE AS spatial_coherence, s.rooms >= 2 AND coalesce(t.rl, false) AS is_dwelling_unit
   FROM (SELECT app_id, cl, count(*) AS n, count(*) FILTER (node_type = 'Room') AS rooms FROM l GROUP BY 1, 2) s LEFT JOIN (SELECT app_id, cl, count(*) AS e, count(*) FILTER (inn) AS i, bool_or(rl) AS rl FROM touch GROUP BY 1, 2) t USING (app_id, cl))"""


def _given_labels(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A stated partition of the spatial nodes (twelve classes per application), as an index would deliver it."""
    nodes = _nodes(t)
    kept, edges = G.spatial(nodes, _edges(t, nodes))
    labels = kept.select("app_id", "node_id", (F.col("ord") % 12).cast("string").alias("label"))
    return labels, kept, edges


@query("A16 G31 G32 G33", f"WITH {_COMMUNITY} SELECT * FROM prof")
def community_profiles(t: Tables) -> DataFrame:
    labels, nodes, edges = _given_labels(t)
    return C.profiles(labels, nodes, edges, ["app_id"])


@query(
    "G34 A15",
    f"WITH {_COMMUNITY} SELECT app_id, count(*) AS communities, round(avg(node_count), 8) AS avg_size, round(avg(spatial_coherence), 8) AS avg_coherence, count(*) FILTER (is_dwelling_unit) AS dwelling_units FROM prof GROUP BY 1",
)
def community_roll_up(t: Tables) -> DataFrame:
    labels, nodes, edges = _given_labels(t)
    return C.roll_up(C.profiles(labels, nodes, edges, ["app_id"]), ["app_id"])


@query("G31", f"WITH {_COMMUNITY} SELECT app_id, cl AS label, node_type, count(*) AS members FROM l GROUP BY 1, 2, 3")
def community_composition(t: Tables) -> DataFrame:
    labels, nodes, _ = _given_labels(t)
    return C.composition(labels, nodes, ["app_id"])


@query(
    "J19 A15",
    f"""WITH {_GRAPH} SELECT g.app_id, g.node_id AS src, concat('community_', e.ord % 9) AS dst, 'IN_COMMUNITY' AS edge_type FROM gnodes g JOIN graph_entities e ON e.app_id = g.app_id AND e.id = g.entity_id""",
)
def listed_communities(t: Tables) -> DataFrame:
    """Community rows with entity lists, as a graph index delivers them, linked to nodes."""
    members = t.entities.select("app_id", "id", (F.col("ord") % 9).cast("string").alias("community"))
    cut = members.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    lists = cut.groupBy("app_id", "community", "part").agg(F.collect_list("id").alias("entity_ids")).withColumnRenamed("community", "id")
    return G.community_members(lists, _nodes(t)).select("app_id", "src", "dst", "edge_type")


@query(
    "J20 J21 G35",
    """WITH k AS (SELECT app_id, field_name, arg_max(cl, node_id) AS cl FROM (SELECT app_id, field_name, node_id, CAST(length(CASE WHEN source = 'form' THEN node_id ELSE concat('f:', substr(node_id, 3), ':floor_area') END) % 5 AS VARCHAR) AS cl FROM case_claims) WHERE cl IS NOT NULL GROUP BY 1, 2),
    c AS (SELECT submission_id AS app_id, check_id, status, CASE rule_id WHEN 'R1' THEN ['site_address'] WHEN 'R2' THEN ['proposed_use', 'postcode'] WHEN 'R3' THEN ['application_ref'] ELSE ['proposed_use', 'setback_distance'] END AS f FROM case_checks),
    p AS (SELECT c.app_id, c.check_id, c.status, coalesce(a.cl, b.cl, '-1') AS label FROM c LEFT JOIN k a ON a.app_id = c.app_id AND a.field_name = f[1] LEFT JOIN k b ON b.app_id = c.app_id AND b.field_name = f[2])
    SELECT app_id, label, count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'fail') AS fail, count(*) FILTER (status = 'warning') AS warning, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) AS total FROM p GROUP BY 1, 2""",
)
def community_compliance(t: Tables) -> DataFrame:
    s = t.by_submission
    labels = s.form_claims.select("app_id", "node_id", (F.length("node_id") % 5).cast("string").alias("label"))
    # measured claims have no community of their own: the floor area of the same line comes before them
    line = F.substring("node_id", F.lit(3), F.length("node_id"))
    edges = s.geometry_claims.select("app_id", F.concat(F.lit("f:"), line, F.lit(":floor_area")).alias("src"), F.col("node_id").alias("dst"))
    fields = C.claim_communities(s.claims.select("app_id", "node_id", "field_name"), labels, edges)
    rule = F.col("rule_id")
    required = (
        F.when(rule == "R1", F.array(F.lit("site_address")))
        .when(rule == "R2", F.array(F.lit("proposed_use"), F.lit("postcode")))
        .when(rule == "R3", F.array(F.lit("application_ref")))
        .otherwise(F.array(F.lit("proposed_use"), F.lit("setback_distance")))
    )
    checks = s.checks.select(F.col("submission_id").alias("app_id"), "check_id", "status", required.alias("required_fields"))
    return C.compliance(checks, fields)


# ---- evaluation --------------------------------------------------------------------------------

_SETS = """truth AS (SELECT l_suppkey AS k, p_type AS kind, lower(p_name) AS label FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'R'),
 pred AS (SELECT l_suppkey AS k, p_type AS kind, lower(p_name) AS label FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'F'),
 lab AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.kind, b.kind) AS kind, coalesce(t, 0) AS t, coalesce(p, 0) AS p FROM (SELECT k, kind, label, count(*) AS t FROM truth GROUP BY 1, 2, 3) a FULL JOIN (SELECT k, kind, label, count(*) AS p FROM pred GROUP BY 1, 2, 3) b ON a.k = b.k AND a.kind = b.kind AND a.label = b.label),
 cnt AS (SELECT k, kind, sum(least(t, p))::BIGINT AS tp, sum(p - least(t, p))::BIGINT AS fp, sum(t - least(t, p))::BIGINT AS fn FROM lab GROUP BY 1, 2)"""
_SCORES = "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS rc"


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    parts = t.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("kind"), F.col("p_name").alias("label"))
    rows = t.raw("lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_linestatus").join(parts, "l_partkey")
    keyed = rows.withColumnRenamed("l_suppkey", "submission_id")
    return keyed.where("l_returnflag <> 'R'"), keyed.where("l_linestatus = 'F'")


@query(
    "M1 M4 G36 G37",
    f"""WITH {_SETS}, r AS (SELECT kind AS entity_type, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM cnt GROUP BY 1 UNION ALL SELECT 'overall', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM cnt), s AS (SELECT *, {_SCORES} FROM r)
    SELECT entity_type, tp, fp, fn, round(pr, 6)::DOUBLE AS precision, round(rc, 6)::DOUBLE AS recall, round(CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END, 6)::DOUBLE AS f1 FROM s""",
)
def entity_metrics(t: Tables) -> DataFrame:
    truth, predicted = _sides(t)
    counts = M.label_counts(truth, predicted, ["submission_id", "kind"])
    return M.per_type_and_overall(counts.withColumnRenamed("kind", "entity_type"), "entity_type")


@query(
    "G38 G36",
    f"""WITH {_SETS}, r AS (SELECT k, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM cnt GROUP BY 1), s AS (SELECT *, {_SCORES} FROM r),
    m AS (SELECT round(pr, 6) AS pr, round(rc, 6) AS rc, round(CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END, 6) AS f1 FROM s)
    SELECT round(avg(pr), 6)::DOUBLE AS precision, round(avg(rc), 6)::DOUBLE AS recall, round(avg(f1), 6)::DOUBLE AS f1 FROM m""",
)
def macro_metrics(t: Tables) -> DataFrame:
    truth, predicted = _sides(t)
    counts = M.label_counts(truth, predicted, ["submission_id", "kind"]).groupBy("submission_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return M.macro_average(M.with_scores(counts))


#: Predictions p(k, n) of each group in order, their fitting truth numbers fitting(k, n, ms), one after the other.
_IN_ORDER = """
 size AS (SELECT k, count(*) AS n FROM p GROUP BY 1),
 step(k, n, taken) AS (SELECT k, 0::BIGINT, []::BIGINT[] FROM size UNION ALL
   SELECT s.k, s.n + 1, list_concat(s.taken, list_filter(f.ms, lambda x: NOT list_contains(s.taken, x))[1:1]) FROM step s JOIN size z ON z.k = s.k AND s.n < z.n LEFT JOIN fitting f ON f.k = s.k AND f.n = s.n + 1),
 found AS (SELECT s.k, len(s.taken)::BIGINT AS tp, z.n AS p FROM step s JOIN size z ON z.k = s.k AND z.n = s.n),
 truths AS (SELECT k, count(*) AS t FROM tr GROUP BY 1),
 cnt AS (SELECT coalesce(h.k, u.k) AS k, coalesce(tp, 0) AS tp, coalesce(p, 0) - coalesce(tp, 0) AS fp, coalesce(t, 0) - coalesce(tp, 0) AS fn FROM found h FULL JOIN truths u ON u.k = h.k)"""
_ROUNDED = "round(pr, 6)::DOUBLE AS precision, round(rc, 6)::DOUBLE AS recall, round(CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END, 6)::DOUBLE AS f1"
_TOTALS = "sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn"


@query(
    "M1",
    f"""WITH RECURSIVE v AS (SELECT app_id AS k, node_id, source, lower(trim(field_name)) AS label, TRY_CAST(regexp_replace(field_value, '[^\\d.\\-]', '', 'g') AS DOUBLE) AS a FROM case_claims),
    p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY node_id) AS n FROM v WHERE source = 'form'), tr AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY node_id) AS m FROM v WHERE source = 'geometry'),
    fitting AS (SELECT p.k, n, list(m ORDER BY m) AS ms FROM p JOIN tr ON tr.k = p.k AND (tr.label = p.label OR abs(tr.a - p.a) / greatest(tr.a, 1e-9) <= 0.10) GROUP BY 1, 2),
    {_IN_ORDER}, s AS (SELECT *, {_SCORES} FROM (SELECT {_TOTALS} FROM cnt)) SELECT tp, fp, fn, {_ROUNDED} FROM s""",
)
def sequential_match(t: Tables) -> DataFrame:
    """Form claims matched with geometry claims of the same submission: same name, or values within 10 %."""
    none = F.lit(None).cast("string")
    claims = cut_lineage(t.claims.select("app_id", "node_id", "source", F.col("field_name").alias("label"), X.parse_number(F.col("field_value")).alias("area")))
    truth = claims.where("source = 'geometry'").select("app_id", F.col("node_id").alias("truth_id"), "label", none.alias("match_key"), "area")
    predicted = claims.where("source = 'form'").select("app_id", F.col("node_id").alias("pred_id"), "label", none.alias("entity_key"), "area")
    matches = O.match_in_order(*O.entity_sides(truth, predicted, ["app_id"]), ["app_id"])
    counts = O.match_counts(truth, predicted, matches, ["app_id"])
    return M.with_scores(counts.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


@query(
    "M1",
    f"""WITH RECURSIVE {_GRAPH}, v AS (SELECT app_id || '|' || node_type AS k, node_type, entity_id, ord, lower(trim(label)) AS label FROM gnodes),
    p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS n FROM v),
    tr AS (SELECT k, node_type, row_number() OVER (PARTITION BY k ORDER BY ord) AS m, regexp_replace(label, ' [0-9]+$', '') AS part, label FROM v WHERE ord % 3 > 0),
    fitting AS (SELECT p.k, n, list(m ORDER BY m) AS ms FROM p JOIN tr ON tr.k = p.k AND (p.label = tr.label OR contains(p.label, tr.part)) GROUP BY 1, 2),
    {_IN_ORDER}, r AS (SELECT split_part(k, '|', 2) AS entity_type, {_TOTALS} FROM cnt GROUP BY 1 UNION ALL SELECT 'overall', {_TOTALS} FROM cnt), s AS (SELECT *, {_SCORES} FROM r)
    SELECT entity_type, tp, fp, fn, {_ROUNDED} FROM s""",
)
def keyed_entity_metrics(t: Tables) -> DataFrame:
    """Graph entities against two thirds of them, which fit by label or by their name without its number."""
    keys = ["app_id", "node_type"]
    label = F.lower(F.trim("label"))
    items = cut_lineage(_nodes(t).select(*keys, "ord", "label"))
    part = F.regexp_replace(label, " [0-9]+$", "")
    area = F.lit(None).cast("double").alias("area")
    truth = items.where("ord % 3 > 0").select(*keys, F.col("ord").alias("truth_id"), "label", part.alias("match_key"), area)
    predicted = items.select(*keys, F.col("ord").alias("pred_id"), "label", label.alias("entity_key"), area)
    matches = O.match_in_order(*O.entity_sides(truth, predicted, keys), keys)
    counts = O.match_counts(truth, predicted, matches, keys)
    return M.per_type_and_overall(counts.withColumnRenamed("node_type", "entity_type"), "entity_type")


@query(
    "M2 J22",
    f"""WITH RECURSIVE {_GRAPH}, e AS (SELECT e.app_id || '|' || edge_type AS k, edge_type, src || '>' || dst AS id, lower(a.label) AS sl, lower(b.label) AS dl, weight FROM gedges e
      JOIN gnodes a ON a.app_id = e.app_id AND a.node_id = e.src JOIN gnodes b ON b.app_id = e.app_id AND b.node_id = e.dst),
    p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS n FROM e),
    tr AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY id) AS m, regexp_extract(CASE edge_type WHEN 'ADJACENT_TO' THEN dl ELSE sl END, '^\\S+ \\S+') AS a, regexp_extract(CASE edge_type WHEN 'ADJACENT_TO' THEN sl ELSE dl END, '^\\S+') AS b FROM e WHERE weight >= 10),
    fitting AS (SELECT p.k, n, list(m ORDER BY m) AS ms FROM p JOIN tr ON tr.k = p.k AND ((contains(sl, a) AND contains(dl, b)) OR (edge_type = 'ADJACENT_TO' AND contains(dl, a) AND contains(sl, b))) GROUP BY 1, 2),
    {_IN_ORDER}, r AS (SELECT split_part(k, '|', 2) AS type, {_TOTALS} FROM cnt GROUP BY 1 UNION ALL SELECT 'overall', {_TOTALS} FROM cnt), s AS (SELECT *, {_SCORES} FROM r)
    SELECT type, tp, fp, fn, {_ROUNDED} FROM s""",
)
def relationship_metrics(t: Tables) -> DataFrame:
    """Edges of the graph against the heavier ones, which are known by parts of their end labels; adjacency is turned round."""
    nodes = _nodes(t)
    ends = [nodes.select("app_id", F.col("node_id").alias(end), F.col("label").alias(f"{end}_label")) for end in ("src", "dst")]
    edges = _edges(t, nodes).join(ends[0], ["app_id", "src"]).join(ends[1], ["app_id", "dst"]).withColumn("id", F.concat("src", F.lit(">"), "dst"))
    edges = cut_lineage(edges.select("app_id", F.col("edge_type").alias("type"), "id", "src_label", "dst_label", "weight"))
    turned = F.col("type") == "ADJACENT_TO"
    one, two = F.when(turned, F.col("dst_label")).otherwise(F.col("src_label")), F.when(turned, F.col("src_label")).otherwise(F.col("dst_label"))
    truth = edges.where("weight >= 10").select(
        "app_id", "type", F.col("id").alias("truth_id"), F.regexp_extract(one, r"^\S+ \S+", 0).alias("src"), F.regexp_extract(two, r"^\S+", 0).alias("dst")
    )
    predicted = edges.select("app_id", "type", F.col("id").alias("pred_id"), "src_label", "dst_label")
    matches = O.match_in_order(*O.relationship_sides(truth, predicted, ["app_id"]), ["app_id", "type"])
    return M.per_type_and_overall(O.match_counts(truth, predicted, matches, ["app_id", "type"]), "type")


_KIND = "CASE WHEN regexp_matches(lower(field_name), 'area|sqm') THEN 'area' WHEN regexp_matches(lower(field_name), 'height|ridge|eaves') THEN 'height' WHEN regexp_matches(lower(field_name), 'distance|boundary|setback') THEN 'distance' ELSE 'value' END"


@query(
    "M3",
    f"""WITH RECURSIVE {_BRUTE}, p AS (SELECT app_id || '|' || kind AS k, kind, lower(field_name) AS fn, row_number() OVER (PARTITION BY app_id, kind ORDER BY ia || '|' || ib || '|' || field_name) AS n FROM worst),
    tv AS (SELECT app_id || '|' || {_KIND} AS k, lower(field_name) AS fn, node_id FROM case_claims WHERE source = 'geometry' OR field_name = 'application_ref'),
    tr AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY node_id) AS m FROM tv),
    fitting AS (SELECT p.k, n, list(m ORDER BY m) AS ms FROM p JOIN tr ON tr.k = p.k AND (contains(p.fn, tr.fn) OR contains(tr.fn, p.fn) OR (regexp_matches(p.fn, 'area|sqm') AND regexp_matches(tr.fn, 'area|sqm'))
      OR (regexp_matches(p.fn, 'height|ridge|eaves') AND regexp_matches(tr.fn, 'height|ridge|eaves')) OR (regexp_matches(p.fn, 'distance|setback|boundary') AND regexp_matches(tr.fn, 'distance|setback|boundary'))) GROUP BY 1, 2),
    {_IN_ORDER}, r AS (SELECT split_part(k, '|', 2) AS conflict_type, {_TOTALS} FROM cnt GROUP BY 1 UNION ALL SELECT 'overall', {_TOTALS} FROM cnt), s AS (SELECT *, {_SCORES} FROM r)
    SELECT conflict_type, tp, fp, fn, {_ROUNDED} FROM s""",
)
def conflict_metrics(t: Tables) -> DataFrame:
    """Detected conflicts against those expected wherever geometry states a value, and on every reference."""
    keys = ["app_id", "conflict_type"]
    found = X.detect_conflicts(t.by_submission.claims).select(*keys, F.concat("claim_a_id", F.lit("|"), "claim_b_id", F.lit("|"), "field_name").alias("pred_id"), "field_name")
    found = cut_lineage(found)
    expected = t.claims.where("source = 'geometry' OR field_name = 'application_ref'")
    truth = expected.select("app_id", X.conflict_type(F.col("field_name")).alias("conflict_type"), F.col("node_id").alias("truth_id"), "field_name")
    truth = cut_lineage(truth)
    matches = O.match_in_order(*O.conflict_sides(truth, found, ["app_id"]), keys)
    return M.per_type_and_overall(O.match_counts(truth, found, matches, keys), "conflict_type")


@query(
    "G39 U9",
    """WITH l AS (SELECT d.lang, l.quality AS a, CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS b FROM labels l JOIN documents d USING (doc_id)),
    c AS (SELECT lang, count(*) AS n, sum(a) AS pa, sum(b) AS pb, count(*) FILTER (a = b) AS s FROM l WHERE a = 1 OR b = 1 GROUP BY 1),
    k AS (SELECT *, s / n AS po, (pa / n) * (pb / n) + ((n - pa) / n) * ((n - pb) / n) AS pe FROM c),
    v AS (SELECT *, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa FROM k)
    SELECT lang, n AS n_items, pa::BIGINT AS positives_a, pb::BIGINT AS positives_b, s AS agreements, kappa,
      CASE WHEN kappa < 0 THEN 'poor' WHEN kappa < 0.2 THEN 'slight' WHEN kappa < 0.4 THEN 'fair' WHEN kappa < 0.6 THEN 'moderate' WHEN kappa < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS interpretation FROM v""",
)
def rater_agreement(t: Tables) -> DataFrame:
    """Documents two raters marked (a label, and a length rule), over the union of marks, per language."""
    rows = t.raw("labels").join(t.raw("documents").select("doc_id", "lang", "n_chars"), "doc_id")
    a = rows.where("quality = 1").select("lang", "doc_id")
    b = rows.where("n_chars > 1500").select("lang", "doc_id")
    return M.cohen_kappa(a, b, ["lang"], ["doc_id"])


_VERDICTS = """flat AS (SELECT submission_id, rule_id, status FROM case_checks QUALIFY row_number() OVER (PARTITION BY submission_id, rule_id ORDER BY check_id DESC) = 1),
 graph AS (SELECT submission_id, rule_id, CASE WHEN severity = 'error' AND status = 'needs_review' THEN 'fail' ELSE status END AS status FROM case_checks WHERE rule_id <> 'R5' QUALIFY row_number() OVER (PARTITION BY submission_id, rule_id ORDER BY check_id) = 1),
 expected AS (SELECT o_orderkey AS submission_id, unnest(['R1', 'R2', 'R4', 'R9']) AS rule_id, CASE o_orderstatus WHEN 'F' THEN 'pass' ELSE 'fail' END AS expected FROM orders)"""


def _verdicts(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    flat = t.checks.select("submission_id", "rule_id", "status", F.col("check_id").alias("ord"))
    first = t.checks.where("rule_id <> 'R5'").groupBy("submission_id", "rule_id").agg(F.min(F.struct("check_id", "status", "severity")).alias("f"))
    raised = F.when((F.col("f.severity") == "error") & (F.col("f.status") == "needs_review"), "fail").otherwise(F.col("f.status"))
    graph = first.select("submission_id", "rule_id", raised.alias("status"), F.lit(0).alias("ord"))
    expected = t.submissions.select(
        F.col("id").alias("submission_id"),
        F.explode(F.array(*[F.lit(r) for r in ("R1", "R2", "R4", "R9")])).alias("rule_id"),
        F.when(F.col("status") == "completed", "pass").otherwise("fail").alias("status"),
    )
    return flat, graph, expected


@query(
    "G41 M6",
    f"""WITH {_VERDICTS} SELECT coalesce(f.submission_id, e.submission_id) AS submission_id, count(*) FILTER (status = expected) AS tp,
      count(*) FILTER ((status IS NOT NULL AND expected IS NOT NULL AND status <> expected) OR expected IS NULL) AS fp, count(*) FILTER (status IS NULL) AS fn
    FROM flat f FULL JOIN expected e ON e.submission_id = f.submission_id AND e.rule_id = f.rule_id GROUP BY 1""",
)
def verdict_metrics(t: Tables) -> DataFrame:
    flat, _, expected = _verdicts(t)
    return M.verdict_counts(flat, expected)


@query(
    "G40 J23 M6",
    f"""WITH {_VERDICTS} SELECT f.submission_id, count(*) FILTER (f.status = g.status) AS agreements, count(*) FILTER (f.status <> g.status) AS disagreements,
      count(*) FILTER (f.status <> g.status AND g.status = expected) AS graph_only_correct, count(*) FILTER (f.status <> g.status AND f.status = expected) AS flat_only_correct
    FROM flat f JOIN graph g USING (submission_id, rule_id) LEFT JOIN expected e USING (submission_id, rule_id) GROUP BY 1""",
)
def verdict_comparison(t: Tables) -> DataFrame:
    flat, graph, expected = _verdicts(t)
    return M.compare_verdicts(flat, graph, expected)


@query(
    "M5",
    f"""WITH {_BRUTE.strip()}, {_COMMUNITY},
    v AS (SELECT CASE WHEN pct > 0.25 THEN 'fail' ELSE 'warning' END AS status, concat('CONFLICT-', kind, '-', field_name) AS rule_id FROM worst
      UNION ALL SELECT 'warning', concat('SPATIAL-COMMUNITY-', cl, '-boundary') FROM (SELECT app_id, cl, bool_or(node_type = 'Room') AS rooms, bool_or(node_type = 'Boundary') AS edge FROM l GROUP BY 1, 2) WHERE rooms AND NOT edge)
    SELECT status, count(*) AS verdicts, count(DISTINCT rule_id) AS rules FROM v GROUP BY 1""",
)
def graph_verdicts(t: Tables) -> DataFrame:
    found = X.detect_conflicts(t.by_submission.claims).withColumn("app_id", F.concat(F.lit("case-"), "app_id"))
    labels, nodes, _ = _given_labels(t)
    united = M.graph_verdicts(found, labels, nodes)
    return united.groupBy("status").agg(F.count(F.lit(1)).alias("verdicts"), F.count_distinct("rule_id").alias("rules"))


@query("M7 M8 M10")
def degradation_sweep(t: Tables) -> DataFrame:
    """Nodes and edges left at each degradation rate, per application."""
    nodes = _nodes(t)
    edges = _edges(t, nodes)
    kept, alive = M.degradation_sweep(nodes.select("app_id", "node_id", "node_type"), edges.select("app_id", "src", "dst", "edge_type"), [0.0, 0.05, 0.10, 0.20, 0.30, 0.50])
    n = kept.groupBy("app_id", "rate").agg(F.count(F.lit(1)).alias("nodes"))
    m = alive.groupBy("app_id", "rate").agg(F.count(F.lit(1)).alias("edges"))
    return n.join(m, ["app_id", "rate"], "left").fillna(0, ["edges"])


@query(
    "M7",
    f"""WITH {_GRAPH}, c AS (SELECT app_id, count(*) AS n, count(*) FILTER (node_type IN ('Room', 'Building', 'Boundary', 'Opening')) AS s FROM gnodes GROUP BY 1)
    SELECT app_id, r.rate, n - CAST(floor(s * r.rate + 1e-9) AS BIGINT) AS nodes FROM c, (SELECT unnest([0.0, 0.05, 0.1, 0.2, 0.3, 0.5])::DOUBLE AS rate) r""",
)
def degraded_node_counts(t: Tables) -> DataFrame:
    nodes = _nodes(t).select("app_id", "node_id", "node_type").withColumn("rate", F.explode(F.array(*[F.lit(r) for r in (0.0, 0.05, 0.10, 0.20, 0.30, 0.50)])))
    none = nodes.where("false").select("app_id", "rate", F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    kept, _ = M.drop_entities(nodes, none, ["app_id", "rate"], F.col("rate"))
    return kept.groupBy("app_id", "rate").agg(F.count(F.lit(1)).alias("nodes"))


@query("M9 M10")
def perturbed_conflicts(t: Tables) -> DataFrame:
    """Conflicts found after five percent noise on all numeric claims, by type and severity."""
    noisy = M.perturb_values(t.by_submission.claims, F.lit(0.05))
    return X.detect_conflicts(noisy).groupBy("conflict_type", "severity").agg(F.count(F.lit(1)).alias("conflicts"))
