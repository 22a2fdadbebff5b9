"""Graph building, components, communities, matching and robustness."""

import random

import pytest

from pyspark.sql import functions as F

from casegrid.operators import community as C
from casegrid.operators import evaluate as M
from casegrid.operators import matching as O
from casegrid.operators import graph as G


def measures(spark, text):
    row = spark.createDataFrame([(text,)], "d string").select(G.all_measurements(F.col("d")).alias("m")).first()
    return [(m.value, m.unit) for m in row.m]


def test_measurement_strings(spark):
    assert measures(spark, "15 sqm") == [(15.0, "sqm")]
    assert measures(spark, "22.5 sq m") == [(22.5, "sqm")]
    assert measures(spark, "8.5 metres") == [(8.5, "m")]
    assert measures(spark, "450 m²") == [(450.0, "sqm")]
    assert measures(spark, "17 m² in one, 47.97 m² in the other") == [(17.0, "sqm"), (47.97, "sqm")]
    assert measures(spark, "9 sqm and 9 sqm") == [(9.0, "sqm")]
    assert measures(spark, "") == []
    assert (4.0, "3.7") in measures(spark, "room of 4 x 3.7m")


def test_components_and_summary(spark):
    nodes = spark.createDataFrame([("a", f"n{i:02d}") for i in range(30)], "app_id string, node_id string")
    chain = [("a", f"n{i:02d}", f"n{i + 1:02d}", "ADJACENT_TO") for i in range(19)]
    edges = spark.createDataFrame(chain + [("a", "n25", "n24", "CONTAINS")], "app_id string, src string, dst string, edge_type string")
    parts = G.components(nodes, edges)
    assert parts.select("component").distinct().count() == 10
    row = G.graph_summary(nodes, edges, parts).first()
    assert (row.total_nodes, row.total_edges, row.components, row.connected) == (30, 20, 10, False)


def test_communities_of_cliques(spark):
    names = [f"c{c}n{i}" for c in range(3) for i in range(5)]
    pairs = [("a", f"c{c}n{i}", f"c{c}n{j}", 1.0) for c in range(3) for i in range(5) for j in range(i + 1, 5)]
    nodes = C.with_resolutions(spark.createDataFrame([("a", n) for n in names], "app_id string, node_id string"), [1.0])
    edges = C.with_resolutions(spark.createDataFrame(pairs, "app_id string, src string, dst string, weight double"), [1.0])
    labels = C.detect(nodes, edges, levels=1).collect()
    groups = {}
    for r in labels:
        groups.setdefault(r.label, set()).add(r.node_id[:2])
    assert len(labels) == 15 and sorted(map(tuple, groups.values())) == [("c0",), ("c1",), ("c2",)]


def test_communities_are_split_where_their_links_do_not_connect_them(spark):
    edges = [("a", g, x, y, 1.0) for g in (0.5, 1.0) for x, y in ("pq", "qr", "st", "tu", "ru")]
    links = C._links(spark.createDataFrame(edges, "app_id string, gamma double, src string, dst string, weight double"))
    degrees = links.groupBy("app_id", "gamma", F.col("src").alias("node_id")).agg(F.sum("weight").alias("k"))
    given = [("a", 0.5, n, "one") for n in "pqrstu"] + [("a", 1.0, n, "x" if n in "pqst" else "y") for n in "pqrstu"]
    labels = spark.createDataFrame(given, "app_id string, gamma double, node_id string, label string")
    split = C.connected(links, labels)
    got = {(r.gamma, r.node_id): r.label for r in split.collect()}
    assert got == {(0.5, n): "p" for n in "pqrstu"} | {(1.0, n): x for n, x in zip("pqrstu", "pprssr")}
    before = {r.gamma: r.modularity for r in C.modularity(links, degrees, labels).collect()}
    after = {r.gamma: r.modularity for r in C.modularity(links, degrees, split).collect()}
    assert after[0.5] == pytest.approx(before[0.5]) and after[1.0] > before[1.0]


def test_detected_communities_are_connected(spark):
    rng = random.Random(8)
    names = [f"n{i:02d}" for i in range(24)] + ["alone"]
    pairs = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(24), rng.randrange(24)) for _ in range(36)) if a != b}
    rows = [("g", names[a], names[b], float(rng.randint(1, 3))) for a, b in sorted(pairs)]
    nodes = C.with_resolutions(spark.createDataFrame([("g", n) for n in names], "app_id string, node_id string"), [1.0])
    edges = C.with_resolutions(spark.createDataFrame(rows, "app_id string, src string, dst string, weight double"), [1.0])
    label = {r.node_id: r.label for r in C.detect(nodes, edges, levels=1).collect()}
    assert label.keys() == set(names)
    for community in set(label.values()):
        members = {n for n in names if label[n] == community}
        seen, todo = set(), [min(members)]
        while todo:
            at = todo.pop()
            seen.add(at)
            todo += [y for _, a, b, _ in rows for x, y in ((a, b), (b, a)) if x == at and y in members and y not in seen]
        assert seen == members and community == min(members)


def test_profile_and_coherence(spark):
    labels = spark.createDataFrame([("a", "x", "1"), ("a", "y", "1"), ("a", "z", "2")], "app_id string, node_id string, label string")
    nodes = spark.createDataFrame([("a", "x", "Room"), ("a", "y", "Room"), ("a", "z", "Boundary")], "app_id string, node_id string, node_type string")
    edges = spark.createDataFrame([("a", "x", "y"), ("a", "y", "z")], "app_id string, src string, dst string")
    got = {r.label: r for r in C.profiles(labels, nodes, edges, ["app_id"]).collect()}
    assert got["1"].spatial_coherence == 0.5 and got["1"].is_dwelling_unit
    assert got["2"].spatial_coherence == 1.0 and not got["2"].is_dwelling_unit


def in_sequence(truth, predicted, fits):
    """Pairs of the plain pass: each prediction takes the first free truth item it fits."""
    taken, pairs = set(), set()
    for p in sorted(predicted):
        for t in sorted(truth):
            if t not in taken and fits(truth[t], predicted[p]):
                taken.add(t)
                pairs.add((p, t))
                break
    return pairs


def pairs_of(matches):
    rows = [(r.pred_id, r.truth_id) for r in matches.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


TRUTH, PRED = "k string, truth_id int, label string, match_key string, area double", "k string, pred_id int, label string, entity_key string, area double"


@pytest.mark.parametrize("seed, size, labels", [(5, 25, "abc"), (6, 60, "abcdefghijk"), (7, 40, " ")])
def test_entities_match_as_in_the_sequential_pass(spark, seed, size, labels):
    rng = random.Random(seed)

    def item(key):
        return (rng.choice([rng.choice(labels), rng.choice(labels).upper() + " ", None, ""]), rng.choice([None, "", key()]), rng.choice([None, float(rng.randint(5, 40))]))

    truth = {t: item(lambda: rng.choice(["north", "Wall", "rth wa", "x"])) for t in range(size)}
    pred = {p: item(lambda: rng.choice(["North wall", "the x wall", "south"])) for p in range(size)}

    def fits(t, p):
        (a, key, area), (b, text, other) = t, p
        a, b = (a or "").lower().strip(), (b or "").lower().strip()
        same = bool(a) and a == b
        inside = bool(key) and bool(text) and key.lower() in text.lower()
        return same or inside or (area is not None and other is not None and abs(area - other) / max(area, 1e-9) <= 0.10)

    td = spark.createDataFrame([("s", t, *v) for t, v in truth.items()], TRUTH)
    pd_ = spark.createDataFrame([("s", p, *v) for p, v in pred.items()], PRED)
    assert pairs_of(O.match_in_order(*O.entity_sides(td, pd_, ["k"]), ["k"])) == in_sequence(truth, pred, fits)


def test_a_thousand_equal_labels_pair_off_by_rank_without_rounds(spark, monkeypatch):
    def no_round(*_):
        raise AssertionError("a round")

    monkeypatch.setattr(O, "_settled", no_round)
    truth = spark.range(1000).selectExpr("'s' AS k", "cast(id AS int) AS truth_id", "'Room' AS label", "cast(null AS string) AS match_key", "cast(null AS double) AS area")
    pred = spark.range(1200).selectExpr("'s' AS k", "cast(id AS int) AS pred_id", "'room ' AS label", "cast(null AS string) AS entity_key", "cast(null AS double) AS area")
    assert pairs_of(O.match_in_order(*O.entity_sides(truth, pred, ["k"]), ["k"])) == {(i, i) for i in range(1000)}


def test_a_thousand_equal_labels_with_a_few_links_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(O, "_settled", lambda *a, plain=O._settled: rounds.append(1) or plain(*a))
    truth = {i: ("room", None, None) for i in range(1000)} | {5000: ("hall", "hall", None)}
    pred = {i: ("room", None, None) for i in range(1000)} | {200: ("hall", "great hall", None), 700: ("kitchen", "hall door", None)}
    td = spark.createDataFrame([("s", t, *v) for t, v in truth.items()], TRUTH)
    pd_ = spark.createDataFrame([("s", p, *v) for p, v in pred.items()], PRED)
    want = in_sequence(truth, pred, lambda t, p: t[0] == p[0] or bool(t[1]) and bool(p[1]) and t[1] in p[1])
    assert pairs_of(O.match_in_order(*O.entity_sides(td, pd_, ["k"]), ["k"])) == want
    assert len(rounds) <= 2


@pytest.mark.parametrize("seed, labels", [(15, "abc"), (16, "abcdefghijklmnop")])
def test_large_groups_are_cut_into_parts_that_nothing_connects(spark, monkeypatch, seed, labels):
    monkeypatch.setattr(O, "GROUP", 10)
    rng = random.Random(seed)
    keys = ["north", "wall", "gate", "yard"]
    truth = {t: (rng.choice([rng.choice(labels), None]), rng.choice([None, *keys])) for t in range(60)}
    pred = {p: (rng.choice([rng.choice(labels), None]), rng.choice([None, *[f"the {k} side" for k in keys], "north wall"])) for p in range(60)}
    want = in_sequence(truth, pred, lambda t, p: bool(t[0]) and t[0] == p[0] or bool(t[1]) and bool(p[1]) and t[1] in p[1])
    td = spark.createDataFrame([("s", t, *v, None) for t, v in truth.items()] + [("few", 0, "a", "north", None)], TRUTH)
    pd_ = spark.createDataFrame([("s", p, *v, None) for p, v in pred.items()] + [("few", 0, "x", "north wall", None)], PRED)
    matches = O.match_in_order(*O.entity_sides(td, pd_, ["k"]), ["k"])
    assert pairs_of(matches.where("k = 's'")) == want
    assert pairs_of(matches.where("k = 'few'")) == {(0, 0)}


def test_items_that_fit_by_one_mark_are_no_pairs(spark):
    truth = spark.range(300).selectExpr("'s' AS k", "cast(id AS int) AS truth_id", "concat('t', id) AS label", "'hall' AS match_key", "10.0D AS area")
    pred = spark.range(400).selectExpr("'s' AS k", "cast(id AS int) AS pred_id", "concat('p', id) AS label", "'great hall' AS entity_key", "10.5D AS area")
    sides = O.entity_sides(truth, pred, ["k"])
    assert sides[2].count() == 2
    assert pairs_of(O.match_in_order(*sides, ["k"])) == {(i, i) for i in range(300)}
    ends = [df.selectExpr("k", "'ADJACENT_TO' AS type", i, f"'kitchen' AS {a}", f"'hall' AS {b}") for df, i, a, b in ((truth, "truth_id", "src", "dst"), (pred, "pred_id", "src_label", "dst_label"))]
    sides = O.relationship_sides(*ends, ["k"])
    assert sides[2].count() == 1
    assert pairs_of(O.match_in_order(*sides, ["k", "type"])) == {(i, i) for i in range(300)}


def test_an_item_that_comes_twice_counts_twice(spark):
    truth = spark.createDataFrame([("s", 1, "hall", "hall", None), ("s", 1, "hall", "hall", None), (None, 2, "hall", None, None)], TRUTH)
    pred = spark.createDataFrame([("s", p, label, "great hall", None) for p, label in ((1, "x"), (2, "hall"), (3, "hall"))] + [(None, 4, "hall", None, None)], PRED)
    matches = O.match_in_order(*O.entity_sides(truth, pred, ["k"]), ["k"])
    assert sorted((r.pred_id, r.truth_id) for r in matches.collect()) == [(1, 1), (2, 1)]


def test_groups_of_the_same_names_compare_them_once(spark, monkeypatch):
    compared = []
    monkeypatch.setattr(O, "contained_pairs", lambda parts, *a, plain=O.contained_pairs: compared.append(parts.count()) or plain(parts, *a))
    td = spark.range(50).selectExpr("id AS k", "'value' AS conflict_type", "concat('t', id) AS truth_id", "explode(array('note', 'front note')) AS field_name")
    pd_ = spark.range(50).selectExpr("id AS k", "'value' AS conflict_type", "concat('p', id) AS pred_id", "'a front note' AS field_name")
    truth, predicted, links = O.conflict_sides(td, pd_, ["k"])
    assert sorted(compared) == [1, 2] and links.count() == 100


def test_relationships_match_by_parts_of_both_ends(spark):
    rng = random.Random(4)
    names = ["kitchen", "hall", "Main Kitchen", "great hall east", "wall", "", "ha"]
    kinds = ["ADJACENT_TO", "CONTAINS"]
    truth = {t: (rng.choice(kinds), rng.choice(names), rng.choice(names)) for t in range(30)}
    pred = {p: (rng.choice(kinds), rng.choice(names), rng.choice(names)) for p in range(30)}

    def fits(t, p):
        (kind, a, b), (other, x, y) = t, p
        a, b, x, y = a.lower(), b.lower(), x.lower(), y.lower()
        return kind == other and ((a in x and b in y) or (kind == "ADJACENT_TO" and a in y and b in x))

    td = spark.createDataFrame([("s", k, t, a, b) for t, (k, a, b) in truth.items()], "k string, type string, truth_id int, src string, dst string")
    pd_ = spark.createDataFrame([("s", k, p, a, b) for p, (k, a, b) in pred.items()], "k string, type string, pred_id int, src_label string, dst_label string")
    assert pairs_of(O.match_in_order(*O.relationship_sides(td, pd_, ["k"]), ["k", "type"])) == in_sequence(truth, pred, fits)


def test_conflicts_match_by_name_or_domain(spark):
    rng = random.Random(9)
    names = ["floor_area", "living_room_area", "ridge_height", "eaves", "height", "setback_distance", "boundary", "note", "a_note", "total_sqm_height", None]
    truth = {t: (rng.choice(["x", "y"]), rng.choice(names)) for t in range(40)}
    pred = {p: (rng.choice(["x", "y"]), rng.choice(names)) for p in range(40)}
    domains = [("area", "sqm", "floor_area"), ("height", "ridge", "eaves"), ("distance", "setback", "boundary")]

    def fits(t, p):
        a, b = t[1] or "", p[1] or ""
        return t[0] == p[0] and (a in b or b in a or any(any(w in a for w in d) and any(w in b for w in d) for d in domains))

    td = spark.createDataFrame([("s", k, t, n) for t, (k, n) in truth.items()], "k string, conflict_type string, truth_id int, field_name string")
    pd_ = spark.createDataFrame([("s", k, p, n) for p, (k, n) in pred.items()], "k string, conflict_type string, pred_id int, field_name string")
    sides = O.conflict_sides(td, pd_, ["k"])
    matches = O.match_in_order(*sides, ["k", "conflict_type"])
    assert pairs_of(matches) == in_sequence(truth, pred, fits)
    counts = {r.conflict_type: (r.tp, r.fp, r.fn) for r in O.match_counts(td, pd_, matches, ["conflict_type"]).collect()}
    assert all(tp + fn == sum(k == kind for k, _ in truth.values()) and tp + fp == sum(k == kind for k, _ in pred.values()) for kind, (tp, fp, fn) in counts.items())


def test_kappa(spark):
    df = spark.createDataFrame([("a",), ("b",)], "i string").withColumn("k", F.lit(1))
    same = M.cohen_kappa(df, df, ["k"], ["i"]).first()
    assert same.interpretation == "almost perfect" and same.kappa != same.kappa
    other = spark.createDataFrame([("c",)], "i string").withColumn("k", F.lit(1))
    assert M.cohen_kappa(df, other, ["k"], ["i"]).first().interpretation == "poor"


def test_perturbation_counts(spark):
    nodes = spark.createDataFrame(
        [("g", f"r{i}", "Room", None) for i in range(10)] + [("g", f"c{i}", "Claim", str(10 + i)) for i in range(5)],
        "app_id string, node_id string, node_type string, field_value string",
    )
    edges = spark.createDataFrame([("g", f"r{i}", f"r{i + 1}", "ADJACENT_TO") for i in range(9)], "app_id string, src string, dst string, edge_type string")
    for rate, left in ((0.0, 15), (0.5, 10)):
        kept, alive = M.drop_entities(nodes, edges, ["app_id"], F.lit(rate))
        assert kept.count() == left
        ids = {r.node_id for r in kept.collect()}
        assert all(e.src in ids and e.dst in ids for e in alive.collect())
    assert M.drop_relationships(edges, ["app_id"], F.lit(0.34)).count() == 6
    claims = nodes.where("node_type = 'Claim'")
    one = M.perturb_values(claims, F.lit(0.1), seed=7).orderBy("node_id").collect()
    two = M.perturb_values(claims.repartition(3), F.lit(0.1), seed=7).orderBy("node_id").collect()
    assert one == two and any(r.field_value != str(10 + i) for i, r in enumerate(one))
    assert M.perturb_values(claims, F.lit(0.0)).where("cast(field_value as double) = cast(substr(node_id, 2) as int) + 10").count() == 5


def test_implied_edges(spark):
    nodes = spark.createDataFrame(
        [("a", "p", "Page"), ("a", "r1", "Room"), ("a", "r2", "Room"), ("a", "o", "Opening"), ("a", "b", "Boundary")], "app_id string, node_id string, node_type string"
    )
    edges = spark.createDataFrame([("a", m, "p") for m in ("r1", "r2", "o", "b")], "app_id string, src string, dst string")
    cliques = G.page_cliques(nodes, edges)
    row = G.clique_counts(cliques).first()
    assert (row.adjacent_pairs, row.opens_into_pairs) == (1, 2)
    asked = spark.createDataFrame([("a", "r1", "r2"), ("a", "o", "r1"), ("a", "r1", "b")], "app_id string, a string, b string")
    assert {(r.a, r.b, r.edge_type) for r in G.implied_edge(asked, cliques).collect()} == {("r1", "r2", "ADJACENT_TO"), ("o", "r1", "OPENS_INTO")}


def test_case_graph_links_claims_to_evidence_pages(spark):
    documents = spark.createDataFrame([(1, "d1", "form.pdf"), (1, "d2", "plan.pdf")], "submission_id long, document_id string, filename string")
    pages = spark.createDataFrame([(1, "d1", 1), (1, "d1", 2), (1, "d2", 1)], "submission_id long, document_id string, page_number long")
    fields = spark.createDataFrame(
        [
            (1, "d1", "floor_area", "10", "sqm", "f1", "e1"),
            (1, "d1", "floor_area", "12", "sqm", "f2", "e2"),
            (1, "d2", "ridge_height", "5", "m", "f3", "e3"),
            (1, "d2", "note", "x", None, "f4", None),
            (1, "d2", "note", "x", None, "f5", "e5"),
        ],
        "submission_id long, document_id string, field_name string, field_value string, field_unit string, field_id string, evidence_id string",
    )
    evidence = spark.createDataFrame(
        [("e1", "d1", 2), ("e2", "d1", 1), ("e3", "d1", 2), ("e5", "d2", 7)], "evidence_id string, document_id string, page_number long"
    )
    features = spark.createDataFrame([], "submission_id long, feature_id string, feature_type string")
    metrics = spark.createDataFrame([], "feature_id string, metric_name string, metric_value double, metric_unit string")
    nodes, edges = G.case_graph(documents, pages, fields, evidence, features, metrics)
    ids = [r.node_id for r in nodes.collect()]
    assert len(ids) == len(set(ids)) == 2 + 3 + 2 + 5
    shown = {(r.src, r.dst) for r in edges.where("edge_type = 'EXTRACTED_FROM'").collect()}
    entities = {r.label: r.node_id for r in nodes.where("node_id LIKE 'entity:%'").collect()}
    room, ridge = entities["Floor"], entities["Ridge"]
    assert shown == {("claim:f1", "page:d1:2"), ("claim:f2", "page:d1:1"), ("claim:f3", "page:d1:2"), (room, "page:d1:2"), (ridge, "page:d1:2")}
    cliques = G.page_cliques(nodes, edges)
    assert [tuple(r) for r in G.clique_counts(cliques, edges).collect()] == [(1, "page:d1:2", 1, 0)]
    stated = edges.unionByName(spark.createDataFrame([(1, ridge, room, "ADJACENT_TO")], edges.schema))
    assert [tuple(r) for r in G.clique_counts(cliques, stated).collect()] == [(1, "page:d1:2", 0, 0)]
