"""Typed property graphs as node and edge tables keyed by application."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.functions.codes import contains_any, first_match
from casegrid.operators.ordered import latest
from casegrid.session import cut_lineage

# Entity and relationship types, and keyword classes in order.
ENTITY_TYPES = {"room": "Room", "building": "Building", "boundary": "Boundary", "opening": "Opening", "measurement": "Measurement", "constraint": "Constraint", "sitefeature": "SiteFeature"}
EDGE_TYPES = {
    "contains": "CONTAINS", "adjacent_to": "ADJACENT_TO", "opens_into": "OPENS_INTO", "has_measurement": "HAS_MEASUREMENT",
    "bounds": "BOUNDS", "extracted_from": "EXTRACTED_FROM", "serves": "CONTAINS", "overlooks": "ADJACENT_TO", "accesses": "OPENS_INTO",
}
NAME_KEYWORDS = [
    ("room", "Room"), ("bedroom", "Room"), ("bathroom", "Room"), ("kitchen", "Room"), ("living_room", "Room"), ("lounge", "Room"),
    ("hallway", "Room"), ("corridor", "Room"), ("garage", "Room"), ("utility", "Room"), ("extension", "Room"), ("loft", "Room"),
    ("dormer", "Room"), ("conservatory", "Room"), ("building", "Building"), ("house", "Building"), ("dwelling", "Building"),
    ("property", "Building"), ("boundary", "Boundary"), ("fence", "Boundary"), ("wall", "Boundary"), ("door", "Opening"),
    ("window", "Opening"), ("gate", "Opening"),
]
CONTEXT_TYPES = [("area", "Room"), ("height", "Building"), ("width", "Room"), ("length", "Room"), ("depth", "Room"), ("distance", "Boundary")]
DESCRIPTION_WORDS = [
    ("ADJACENT_TO", ["adjacent", "next to", "neighbour", "neighbor", "border"]),
    ("OPENS_INTO", ["opens into", "door", "access", "entry", "entrance"]),
    ("HAS_MEASUREMENT", ["measurement", "dimension", "distance", "area", "height", "width", "depth"]),
    ("BOUNDS", ["bound", "fence", "wall", "hedge"]),
    ("EXTRACTED_FROM", ["extract", "document", "source", "evidence"]),
    ("CONTAINS", ["contains", "part of", "within", "inside", "located", "house"]),
]
SOURCE_WORDS = [("form", ["form", "application"]), ("statement", ["statement", "planning"]), ("drawing", ["floor", "plan", "drawing", "elevation"])]
SPATIAL_TYPES = ["Room", "Building", "Boundary", "Opening"]
MEASUREMENT_WORDS = ["area", "height", "width", "length", "depth", "distance", "min_distance_to_boundary", "projection_depth"]
NUMBER = r"(\d+\.?\d*)"
MEASURE_PATTERNS = [
    NUMBER + r"\s*(sqm|sq\s*m|m²|m2)",
    NUMBER + r"\s*(square\s*metres?|square\s*meters?)",
    NUMBER + r"\s*(metres?(?![\p{L}\p{N}_])|meters?(?![\p{L}\p{N}_])|m(?![\p{L}\p{N}_]))",
    NUMBER + r"\s*m?\s*[x×]\s*(\d+\.?\d*)\s*m",
]


def _lookup(mapping: dict[str, str], col: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), col)


def _by_words(col: Column, classes: Sequence[tuple[str, list[str]]], default: str) -> Column:
    result = F.lit(default)
    for name, words in reversed(classes):
        result = F.when(contains_any(col, words), F.lit(name)).otherwise(result)
    return result


def node_type(kind: Column, name: Column) -> Column:
    return F.coalesce(_lookup(ENTITY_TYPES, F.lower(F.trim(kind))), first_match(F.lower(name), NAME_KEYWORDS, "Building"))


def edge_type(kind: Column, description: Column) -> Column:
    stated = _lookup(EDGE_TYPES, F.lower(F.trim(F.coalesce(kind, F.lit("")))))
    return F.coalesce(stated, _by_words(F.lower(F.coalesce(description, F.lit(""))), DESCRIPTION_WORDS, "CONTAINS"))


def source_type(title: Column) -> Column:
    return _by_words(F.lower(title), SOURCE_WORDS, "document")


def field_name(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def all_measurements(description: Column) -> Column:
    """array<struct<value, unit>>: matches pattern by pattern, the first unit of a value kept."""

    def matches(pattern: str) -> Column:
        ci = F.lit("(?iU)" + pattern)
        zipped = F.arrays_zip(F.regexp_extract_all(description, ci, 1).alias("v"), F.regexp_extract_all(description, ci, 2).alias("u"))

        def one(x: Column) -> Column:
            unit = F.lower(F.trim(x["u"]))
            plain = (
                F.when(unit.isin("sq m", "m²", "m2") | unit.contains("square"), "sqm")
                .when(unit.isin("metres", "meters", "metre", "meter"), "m")
                .otherwise(unit)
            )
            return F.struct(x["v"].try_cast("double").alias("value"), plain.alias("unit"))

        return F.transform(zipped, one)

    found = F.concat(*[matches(p) for p in MEASURE_PATTERNS])
    values = F.array_distinct(F.transform(found, lambda m: m["value"]))
    first = F.transform(values, lambda v: F.get(F.filter(found, lambda m: m["value"] == v), 0))
    return F.filter(first, lambda m: m["value"].isNotNull())


def text_unit_sources(text_units: DataFrame, documents: DataFrame) -> DataFrame:
    """(text_unit_id, title, source): the title falls back to the document id."""
    titles = documents.select(F.col("id").alias("document_id"), "title")
    titled = F.coalesce("title", "document_id")
    return (
        text_units.where(F.coalesce(F.col("document_id") != "", F.lit(False)))
        .join(titles, "document_id", "left")
        .select(F.col("id").alias("text_unit_id"), titled.alias("title"), source_type(titled).alias("source"))
    )


def entity_sources(entities: DataFrame, units: DataFrame) -> DataFrame:
    """(app_id, id, source, doc_titles): first known source in text-unit order, and the distinct titles."""
    spread = entities.select("app_id", "id", F.posexplode("text_unit_ids").alias("n", "text_unit_id")).join(units, "text_unit_id")
    return spread.groupBy("app_id", "id").agg(
        F.min(F.struct("n", "source"))["source"].alias("source"), F.array_sort(F.collect_set("title")).alias("doc_titles")
    )


def entity_nodes(entities: DataFrame, units: DataFrame) -> DataFrame:
    """Nodes of all entities but measurements; ids are made of type and entity id, so they never move."""
    kind = node_type(F.col("type"), F.col("title"))
    typed = entities.withColumn("node_type", kind).where(F.col("node_type") != "Measurement")
    return typed.join(entity_sources(entities, units), ["app_id", "id"], "left").select(
        "app_id",
        F.concat_ws("_", F.lower("node_type"), "id").alias("node_id"),
        "node_type",
        F.trim("title").alias("label"),
        F.col("id").alias("entity_id"),
        "ord",
        F.coalesce("source", F.lit("unknown")).alias("source"),
        "doc_titles",
        "description",
    )


def relationship_edges(nodes: DataFrame, relationships: DataFrame) -> DataFrame:
    """Edges between the first nodes of each name (case ignored); the last statement about a pair stands."""
    named = nodes.groupBy("app_id", F.lower("label").alias("name")).agg(F.min(F.struct("ord", "node_id"))["node_id"].alias("node_id"))
    src = named.select("app_id", F.col("name").alias("s"), F.col("node_id").alias("src"))
    dst = named.select("app_id", F.col("name").alias("d"), F.col("node_id").alias("dst"))
    typed = relationships.select(
        "app_id",
        F.lower(F.trim("source")).alias("s"),
        F.lower(F.trim("target")).alias("d"),
        "ord",
        "ord2",
        edge_type(F.col("type"), F.col("description")).alias("edge_type"),
        F.coalesce(F.nullif(F.col("weight"), F.lit(0.0)), F.lit(1.0)).alias("weight"),
    )
    # one row per named pair before the names are resolved
    last = latest(typed, ["app_id", "s", "d"], [F.col("ord"), F.col("ord2")], ["ord", "ord2", "edge_type", "weight"])
    joined = last.join(src, ["app_id", "s"]).join(dst, ["app_id", "d"])
    return latest(joined, ["app_id", "src", "dst"], [F.col("ord"), F.col("ord2")], ["edge_type", "weight"])


def measurement_claims(entities: DataFrame, units: DataFrame) -> DataFrame:
    """Claims of measurement entities, one per distinct value, at least one each."""
    measured = entities.where(F.lower("type") == "measurement")
    spread = measured.join(entity_sources(entities, units), ["app_id", "id"], "left").select(
        "app_id",
        "id",
        F.trim("title").alias("title"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.posexplode_outer(all_measurements(F.col("description"))).alias("n", "m"),
    )
    value = F.col("m.value").cast("string")
    return spread.select(
        "app_id",
        F.concat_ws("_", F.lit("claim"), "id", F.coalesce("n", F.lit(0))).alias("node_id"),
        F.lit("Claim").alias("node_type"),
        F.when(value.isNotNull(), F.concat("title", F.lit(": "), value, F.lit(" "), "m.unit")).otherwise(F.col("title")).alias("label"),
        field_name(F.col("title")).alias("field_name"),
        F.coalesce(value, F.lit("")).alias("field_value"),
        F.coalesce("m.unit", F.lit("")).alias("field_unit"),
        "source",
        F.col("id").alias("entity_id"),
    )


def community_members(communities: DataFrame, nodes: DataFrame) -> DataFrame:
    """IN_COMMUNITY edges from listed entities to community nodes."""
    listed = communities.select("app_id", F.col("id").alias("community_id"), F.explode("entity_ids").alias("entity_id"))
    return listed.join(nodes.select("app_id", "entity_id", "node_id"), ["app_id", "entity_id"]).select(
        "app_id",
        F.col("node_id").alias("src"),
        F.concat_ws("_", F.lit("community"), "community_id").alias("dst"),
        F.lit("IN_COMMUNITY").alias("edge_type"),
        "community_id",
    )


# ---- subgraphs and summaries -------------------------------------------------------------------


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    known = nodes.select("app_id", "node_id").distinct()
    return edges.join(known.withColumnRenamed("node_id", "src"), ["app_id", "src"], "left_semi").join(
        known.withColumnRenamed("node_id", "dst"), ["app_id", "dst"], "left_semi"
    )


def by_node_type(nodes: DataFrame, edges: DataFrame, types: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    kept = nodes.where(F.col("node_type").isin(list(types)))
    return kept, induced(kept, edges)


def spatial(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return by_node_type(nodes, edges, SPATIAL_TYPES)


def by_edge_type(nodes: DataFrame, edges: DataFrame, types: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    kept = edges.where(F.col("edge_type").isin(list(types)))
    ends = kept.select("app_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return nodes.join(ends, ["app_id", "node_id"], "left_semi"), kept


def mentioning(nodes: DataFrame, edges: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Nodes whose titles or text name an application, with their direct neighbours, and the edges among them."""
    wanted = text.lower()
    titled = F.coalesce(F.exists("doc_titles", lambda x: F.lower(x).contains(wanted)), F.lit(False))
    spoken = F.lower(F.concat_ws(" ", "source", "description", "label")).contains(wanted)
    seeds = nodes.where(titled | spoken).select("app_id", "node_id")
    both = edges.select("app_id", "src", "dst").unionByName(edges.select("app_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    around = both.join(seeds.withColumnRenamed("node_id", "src"), ["app_id", "src"], "left_semi").select("app_id", F.col("dst").alias("node_id"))
    kept = nodes.join(seeds.unionByName(around).distinct(), ["app_id", "node_id"], "left_semi")
    return kept, induced(kept, edges)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(app_id, node_id, component): smallest reachable id, by min-label spreading with shortcuts.

    Each round a node takes the smallest label around it and then that label's own label, so chains
    shrink by half. Labels travel as aggregates, so a hub is combined on the map side.
    """
    key = F.concat_ws("\u0001", "app_id", "node_id")
    labels = cut_lineage(nodes.select("app_id", "node_id", key.alias("label")))
    pairs = edges.where(F.col("src") != F.col("dst")).select("app_id", "src", "dst")
    links = cut_lineage(pairs.unionByName(pairs.select("app_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    while True:
        sent = links.join(labels.withColumnRenamed("node_id", "src"), ["app_id", "src"]).select("app_id", F.col("dst").alias("node_id"), "label")
        least = labels.unionByName(sent).groupBy("app_id", "node_id").agg(F.min("label").alias("label"))
        owner = least.select(key.alias("owner"), F.col("label").alias("further"))
        jumped = least.join(owner, F.col("label") == F.col("owner")).select("app_id", "node_id", F.least("label", "further").alias("label"))
        step = cut_lineage(jumped)
        moved = step.alias("n").join(labels.alias("o"), ["app_id", "node_id"]).where(F.col("n.label") != F.col("o.label"))
        done = moved.isEmpty()
        labels = step
        if done:
            return labels.withColumnRenamed("label", "component")


def graph_summary(nodes: DataFrame, edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Per application: node, edge and component counts, density and connectedness."""
    counted = nodes.groupBy("app_id").agg(F.count(F.lit(1)).alias("total_nodes"))
    linked = edges.groupBy("app_id").agg(F.count(F.lit(1)).alias("total_edges"))
    split = parts.groupBy("app_id", "component").agg(F.lit(1).alias("one")).groupBy("app_id").agg(F.count(F.lit(1)).alias("components"))
    n, m = F.col("total_nodes"), F.coalesce("total_edges", F.lit(0))
    return (
        counted.join(linked, "app_id", "left")
        .join(split, "app_id", "left")
        .select(
            "app_id",
            "total_nodes",
            m.alias("total_edges"),
            F.round(F.when(n > 1, m / (n * (n - 1))).otherwise(0.0), 8).alias("density"),
            "components",
            (F.col("components") == 1).alias("connected"),
        )
    )


# ---- graph from case tables --------------------------------------------------------------------


def entity_key(name: Column) -> Column:
    """What a field is about: its name without measurement words."""
    result = F.coalesce(name, F.lit(""))
    for word in MEASUREMENT_WORDS:
        result = F.trim(F.regexp_replace(F.regexp_replace(result, word, ""), "_", " "))
    stripped = F.regexp_replace(result, "^_+|_+$", "")
    return F.lower(F.regexp_replace(F.when(stripped == "", "unknown").otherwise(stripped), r"\s+", "_"))


def is_measurement(name: Column, unit: Column) -> Column:
    return (F.trim(F.coalesce(unit, F.lit(""))) != "") | contains_any(F.lower(F.coalesce(name, F.lit(""))), MEASUREMENT_WORDS)


def field_entity_type(name: Column) -> Column:
    lowered = F.lower(F.coalesce(name, F.lit("")))
    return F.coalesce(first_match(lowered, NAME_KEYWORDS, None), first_match(lowered, CONTEXT_TYPES, None), F.lit("Room"))


def entity_label(name: Column) -> Column:
    title = F.initcap(F.translate(name, "_", " "))
    for suffix in ("Area", "Height", "Width", "Length", "Depth", "Distance"):
        title = F.trim(F.regexp_replace(title, suffix + "$", ""))
    return F.when(title == "", name).otherwise(title)


def geometry_type(feature_type: Column) -> Column:
    lowered = F.lower(feature_type)
    return (
        F.when(contains_any(lowered, ["boundary", "fence"]), "Boundary")
        .when(contains_any(lowered, ["extension", "room", "balcony"]), "Room")
        .otherwise("Building")
    )


def case_graph(
    documents: DataFrame, pages: DataFrame, fields: DataFrame, evidence: DataFrame, features: DataFrame, metrics: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of documents, their pages, fields (entities and claims) and geometry, keyed by submission.

    ``pages``: submission_id, document_id, page_number. ``fields`` carry field_id and evidence_id; ``evidence``:
    evidence_id, document_id, page_number. Every field row is a claim of its own. A claim, and an entity through its
    first field, hangs on the page that its evidence names; without evidence, or without such a page, on none.
    """
    app = F.col("submission_id").alias("app_id")

    def node(df: DataFrame, node_id: Column, kind: Column, label: Column) -> DataFrame:
        return df.select(app, node_id.alias("node_id"), kind.alias("node_type"), label.alias("label"))

    def edge(df: DataFrame, src: Column, dst: Column, kind: str) -> DataFrame:
        return df.select(app, src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"))

    doc_id = F.concat(F.lit("doc:"), "document_id")
    page_id = F.concat_ws(":", F.lit("page"), "document_id", "page_number")
    claim_id = F.concat(F.lit("claim:"), "field_id")
    entity_id = F.concat(F.lit("entity:"), entity_key(F.col("field_name")))
    feature_id, metric_id = F.concat(F.lit("geometry:"), "feature_id"), F.concat(F.lit("metric:"), "feature_id", F.lit(":"), "metric_name")
    sheets = pages.select("submission_id", "document_id", "page_number").distinct()
    shown = evidence.join(sheets, ["document_id", "page_number"]).select("submission_id", "evidence_id", page_id.alias("page"))
    measured = fields.where(is_measurement(F.col("field_name"), F.col("field_unit")))
    first = measured.groupBy("submission_id", entity_id.alias("entity")).agg(
        F.min(F.struct("document_id", "field_name", "field_id", "evidence_id")).alias("f")
    )
    named = first.select("submission_id", "entity", F.col("f.field_name").alias("field_name"), F.col("f.evidence_id").alias("evidence_id"))
    # the join deals rows by feature; the other parts may stay where their submission is
    geometry = features.join(metrics, "feature_id").repartition("submission_id")
    nodes = (
        node(documents, doc_id, F.lit("PlanningDocument"), F.col("filename"))
        .unionByName(node(sheets, page_id, F.lit("Page"), F.concat(F.lit("Page "), "page_number")))
        .unionByName(node(named, F.col("entity"), field_entity_type(F.col("field_name")), entity_label(F.col("field_name"))))
        .unionByName(node(fields, claim_id, F.lit("Claim"), F.concat_ws(": ", "field_name", "field_value")))
        .unionByName(node(features, feature_id, geometry_type(F.col("feature_type")), F.col("feature_type")))
        .unionByName(node(geometry, metric_id, F.lit("Claim"), F.concat("metric_name", F.lit(": "), "metric_value", F.lit(" "), "metric_unit")))
    )
    own = ["submission_id", "evidence_id"]
    edges = (
        edge(sheets, doc_id, page_id, "CONTAINS")
        .unionByName(edge(named.join(shown, own), F.col("entity"), F.col("page"), "EXTRACTED_FROM"))
        .unionByName(edge(fields.join(shown, own), claim_id, F.col("page"), "EXTRACTED_FROM"))
        .unionByName(edge(measured, entity_id, claim_id, "CONTAINS"))
        .unionByName(edge(geometry, feature_id, metric_id, "CONTAINS"))
    )
    return nodes, edges


def page_cliques(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Spatial members of each page with what they imply for one another, in compact form.

    Rooms and buildings on one page are adjacent to each other, and openings on it open into its rooms.
    A page with k members implies k(k-1)/2 pairs; it is kept as k member rows and pair counts, and
    `implied_edge` answers for single pairs.
    """
    typed = nodes.where(F.col("node_type").isin(SPATIAL_TYPES)).select("app_id", F.col("node_id").alias("member"), "node_type")
    pages = nodes.where(F.col("node_type") == "Page").select("app_id", F.col("node_id").alias("page"))
    to_page = edges.select("app_id", F.col("src").alias("member"), F.col("dst").alias("page"))
    from_page = edges.select("app_id", F.col("dst").alias("member"), F.col("src").alias("page"))
    touching = to_page.unionByName(from_page).distinct().join(pages, ["app_id", "page"], "left_semi")
    return touching.join(typed, ["app_id", "member"]).select("app_id", "page", "member", "node_type")


def clique_counts(cliques: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Implied edges per page, by closed form; an adjacency that ``edges`` hold already, either way, is not implied."""
    solid = F.count_if(F.col("node_type").isin("Room", "Building"))
    per = cliques.groupBy("app_id", "page").agg(
        solid.alias("solid"), F.count_if(F.col("node_type") == "Room").alias("rooms"), F.count_if(F.col("node_type") == "Opening").alias("openings")
    )
    counted = per.withColumn("stated", F.lit(0))
    if edges is not None:
        solid_members = cliques.where(F.col("node_type").isin("Room", "Building")).select("app_id", "page", "member")
        pairs = edges.where(F.col("src") != F.col("dst")).select("app_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
        both = pairs.join(solid_members.withColumnRenamed("member", "a"), ["app_id", "a"]).join(
            solid_members.withColumnRenamed("member", "b"), ["app_id", "page", "b"]
        )
        stated = both.groupBy("app_id", "page").agg(F.count(F.lit(1)).alias("stated"))
        counted = per.join(stated, ["app_id", "page"], "left").fillna(0, ["stated"])
    return counted.select(
        "app_id",
        "page",
        (F.floor(F.col("solid") * (F.col("solid") - 1) / 2).cast("bigint") - F.col("stated")).alias("adjacent_pairs"),
        (F.col("rooms") * F.col("openings")).alias("opens_into_pairs"),
    )


def implied_edge(pairs: DataFrame, cliques: DataFrame) -> DataFrame:
    """Edge implied for each asked pair (app_id, a, b) that shares a page."""
    a = cliques.select("app_id", "page", F.col("member").alias("a"), F.col("node_type").alias("a_type"))
    b = cliques.select("app_id", "page", F.col("member").alias("b"), F.col("node_type").alias("b_type"))
    joined = pairs.where(F.col("a") != F.col("b")).join(a, ["app_id", "a"]).join(b, ["app_id", "page", "b"])
    opens = ((F.col("a_type") == "Opening") & (F.col("b_type") == "Room")) | ((F.col("b_type") == "Opening") & (F.col("a_type") == "Room"))
    solid = F.col("a_type").isin("Room", "Building") & F.col("b_type").isin("Room", "Building")
    kind = F.when(opens, "OPENS_INTO").when(solid, "ADJACENT_TO")
    return joined.select("app_id", "a", "b", kind.alias("edge_type")).where(F.col("edge_type").isNotNull()).distinct()
