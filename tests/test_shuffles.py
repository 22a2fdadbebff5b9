"""Plans move no more rows between tasks than the work needs: lines are dealt once, while they are narrow."""

import datetime

import pytest
from pyspark.sql import functions as F

from casegrid.operators import conflicts as X
from casegrid.plans.bridge import Tables
from casegrid.plans.registry import all_queries

LINES = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    day = datetime.datetime(1996, 1, 1)
    lines = [(k % 9, k % 7, k % 5, k % 7 + 1, float(k), k % 10 / 100, k % 8 / 100, "RAN"[k % 3], "FO"[k % 2], day) for k in range(80)]
    spark.createDataFrame(lines, LINES).write.parquet(f"{path}/lineitem.parquet")
    orders = [(k, k % 3, "FOP"[k % 3], 10.0 * k, day + datetime.timedelta(days=k), "1-URGENT") for k in range(9)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    return str(path)


def exchanges(df) -> int:
    """Shuffles of the plan as it starts: joins with small sides are turned later."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def built(spark, folder, name):
    return all_queries()[name].build(Tables(spark, folder))


@pytest.mark.parametrize(("name", "most"), [("best_fields", 1), ("field_conflicts", 1), ("conflict_options", 2)])
def test_fields_are_dealt_while_a_line_is_one_row(spark, folder, name, most):
    found = built(spark, folder, name)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert exchanges(found) <= most
    assert "field_name" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert found.count() > 0


def test_a_case_graph_is_counted_where_its_lines_were_dealt(spark, folder):
    found = built(spark, folder, "case_graph_nodes")
    # documents, pages, fields, entities, features; two sides of geometry and its result
    assert exchanges(found) <= 8
    rows = found.collect()
    assert rows and all(r["nodes"] >= r["distinct_ids"] for r in rows)


def test_conflicts_of_dealt_claims_need_no_further_shuffle(spark):
    rows = [("a", f"n{k}", f, str(v), None, s) for k, (f, v, s) in enumerate([("floor_area", 10, "form"), ("floor_area", 30, "form"), ("site_area", 11, "geometry"), ("note", "x", "form"), ("note", "y", "form")])]
    claims = spark.createDataFrame(rows, "app_id string, node_id string, field_name string, field_value string, field_unit string, source string")
    found = X.detect_conflicts(claims.repartition(4, "app_id"))
    assert exchanges(found) == 1
    assert {(r["base_entity"], r["conflict_type"], r["claim_a_id"], r["claim_b_id"]) for r in found.collect()} == {("floor", "area", "n0", "n1"), ("note", "value", "n3", "n4")}


def test_only_the_parents_rows_move_for_a_version_delta(spark, folder):
    from casegrid.operators import versions as V

    t = Tables(spark, folder).by_submission
    pairs = spark.createDataFrame([(1, 0), (2, 1)], "submission_id bigint, parent_id bigint").hint("shuffle_merge")
    found = V.field_deltas(pairs, t.fields)
    # lines and pairs for either side, and the parent's rows
    assert exchanges(found) <= 5


def test_a_sweep_keeps_what_each_rate_alone_would_keep(spark):
    from casegrid.operators import evaluate as M

    rates = [0.0, 0.1, 0.3, 0.5]
    # one node comes twice, one application has no name
    nodes = spark.createDataFrame([(a, f"n{k % 29}", "Room" if k % 4 else "Page") for a in ("x", "y", None) for k in range(30)], "app_id string, node_id string, node_type string")
    edges = spark.createDataFrame([(a, f"n{k % 29}", f"n{k * 7 % 29}", "CONTAINS") for a in ("x", "y", None) for k in range(60)], "app_id string, src string, dst string, edge_type string")
    kept, alive = M.degradation_sweep(nodes, edges, rates)
    assert "explode" not in alive._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)[1].lower()
    for rate in rates:
        one, other = M.drop_entities(nodes, edges, ["app_id"], F.lit(rate), 42)
        other = M.drop_relationships(other, ["app_id"], F.lit(rate), 43)
        assert sorted(map(str, kept.where(f"rate = {rate}").drop("rate").collect())) == sorted(map(str, one.collect()))
        columns = ["app_id", "src", "dst", "edge_type"]
        assert sorted(map(str, alive.where(f"rate = {rate}").select(columns).collect())) == sorted(map(str, other.select(columns).collect()))


def test_communities_of_checks_are_found_where_the_lines_were_dealt(spark, folder):
    from casegrid.operators import community as C

    found = built(spark, folder, "community_compliance")
    # lines and two sides of geometry with its result, wherever claims are read
    assert exchanges(found) <= 10
    rows = [("a", "n1", "area"), ("a", "n2", "area"), ("a", "n3", "note"), ("a", "n4", "loose"), (None, "n1", "area")]
    claims = spark.createDataFrame(rows, "app_id string, node_id string, field_name string")
    labels = spark.createDataFrame([("a", "n1", "1"), ("a", "p1", "7"), ("a", "p2", "8"), (None, "n1", "9")], "app_id string, node_id string, label string")
    edges = spark.createDataFrame([("a", "p2", "n2"), ("a", "p1", "n2"), ("a", "p2", "n3"), ("a", "p3", "n4"), ("a", "p2", "n1")], "app_id string, src string, dst string")
    fields = C.claim_communities(claims, labels, edges)
    assert {tuple(r) for r in fields.collect()} == {("a", "area", "7"), ("a", "note", "8")}
    checks = [("a", "c1", "pass", ["loose", "note"]), ("a", "c2", "fail", ["loose"]), (None, "c3", "fail", ["area"]), ("a", "c4", "fail", []), ("a", "c5", "fail", ["area", "note"])]
    counted = C.compliance(spark.createDataFrame(checks, "app_id string, check_id string, status string, required_fields array<string>"), fields)
    assert sorted((r.app_id or "", r.label, r["pass"], r["fail"]) for r in counted.collect()) == [("", "-1", 0, 1), ("a", "-1", 0, 2), ("a", "7", 0, 1), ("a", "8", 1, 0)]


def test_documents_of_one_row_group_are_extracted_by_many_tasks(spark, tmp_path):
    rows = [(k if k % 9 else None, f"text {k}\nsite address: {k} Mill Lane", "en", "a", 20) for k in range(90)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    dealt = Tables(spark, str(tmp_path)).layouts
    parts = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) > 1 and sum(parts) == 90


def test_a_hit_is_searched_once_whatever_its_uses(spark, tmp_path):
    from casegrid.functions import patterns as P
    from casegrid.operators import extract as E

    spark.createDataFrame([(1, "text", "en", "a", 4)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    found = E.field_rows(E.extract(Tables(spark, str(tmp_path)).layouts, ["doc_id"]), ["doc_id"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(E._any(P.LABELS["agent_name"])) == 1


@pytest.mark.parametrize(("name", "column"), [("changed_documents", "hash_changes"), ("document_multiset_changes", "extra_copies")])
def test_versions_of_documents_are_compared_where_their_lines_were_dealt(spark, folder, name, column):
    found = built(spark, folder, name)
    plan = found._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not any(word in line for line in moved for word in ("name", "member", "content_hash", "document_type"))
    docs = {(k, o): [] for k in range(9) for o in range(7)}
    for k in range(80):
        docs[k % 9, k % 7].append(k % 7)
    # the orders of a customer are three apart
    pairs = [(a - 3, a, line) for a in range(3, 9) for line in range(7)]
    if name == "changed_documents":
        want = sum(len(set(docs[p, n]) ^ set(docs[s, n])) for p, s, n in pairs if docs[p, n] and docs[s, n])
    else:
        want = sum(len(docs[s, n]) - len(docs[p, n]) for p, s, n in pairs)
    assert sum(r[column] for r in found.collect()) == want


def test_sites_are_joined_with_their_metrics_once(spark, folder):
    found = built(spark, folder, "spatial_findings")
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    assert {r.submission_id for r in found.collect()} == set(range(9))


def test_spatial_facts_count_all_and_show_the_first(spark):
    from casegrid.operators import rules as V

    # a feature that comes twice, one without metrics, one of no kind that is checked, one without a submission
    features = spark.createDataFrame([(1, f"f{k}") for k in range(6)] + [(1, "f0"), (2, "g"), (3, "h"), (None, "n")], "submission_id long, feature_id string")
    rows = [(f"f{k}", "floor_area", 30.0 + k, "sqm") for k in range(5)] + [("f5", "setback_distance", 1.0, "m"), ("h", "volume", 9.0, "m3"), ("n", "ridge_height", 30.0, "m"), ("f1", "ridge_height", None, "m"), ("f2", None, 2.0, "m")]
    metrics = spark.createDataFrame(rows, "feature_id string, metric_name string, metric_value double, metric_unit string")
    limits = {"min_setback": 5.0, "max_height": 20.0, "max_area": 22.0, "min_area": 2.0}
    found = V.spatial_facts(features, metrics, limits)
    assert found._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") + found._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 1
    got = {r.submission_id: tuple(r)[1:] for r in found.collect()}
    area = "floor_area: {0}sqm > 22.0sqm (maximum)".format
    assert got[1] == (6, 8, 7, 6, [area(30.0), area(30.0), area(31.0)])
    assert got[2] == (1, 0, None, None, []) and got[3] == (1, 1, None, None, []) and got[None] == (1, 1, None, None, [])


def test_a_graph_is_worked_out_once_for_its_summary(spark, tmp_path):
    day = datetime.datetime(1996, 1, 1)
    lines = [(k % 9, k % 7, k % 5, k % 7 + 1, float(k), 0.1, 0.1, "R", "F", day) for k in range(80)]
    spark.createDataFrame(lines, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(k, "small ring", "Brand#1", "LARGE", 6, 1.0) for k in range(8)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, "x", "en", "a", 1) for k in range(9)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = built(spark, str(tmp_path), "graph_summary")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(f"{name}.parquet" in plan for name in ("lineitem", "part", "documents"))
    assert [(r.total_nodes, r.total_edges, r.components) for r in found.collect()] == [(8, 35, 2)]


def test_character_runs_of_texts_are_never_broadcast(spark):
    from casegrid.operators.matching import contained_pairs

    # stored rows look small, their runs are many
    parts = spark.createDataFrame([("x", "abc"), ("x", "q"), ("x", ""), ("y", "abc")], "app_id string, part string")
    texts = spark.createDataFrame([("x", "zabcd"), ("x", "ab"), ("y", "none"), (None, "abc")], "app_id string, text string")
    found = contained_pairs(parts, texts, ["app_id"])
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["app_id"], r["part"], r["text"]) for r in found.collect()} == {("x", "abc", "zabcd"), ("x", "", "zabcd"), ("x", "", "ab")}


def test_contradictions_are_added_where_claims_were_dealt(spark):
    schema = "app_id string, node_id string, field_name string, field_value string, field_unit string, source string"
    rows = [(a, f"n{k}", "floor_area", str(v), None, "form") for a in ("a", "b", None) for k, v in enumerate([10, 30])]
    claims = spark.createDataFrame(rows, schema).repartition(4, "app_id")
    # the second application knows one end only; nodes and edges come twice
    nodes = spark.createDataFrame([("a", "n0"), ("a", "n1"), ("a", "n1"), ("b", "n0"), (None, "n0"), (None, "n1")], "app_id string, node_id string")
    edges = spark.createDataFrame([(a, "n0", "n1", "CONTAINS") for a in ("a", "b", "b", None)], "app_id string, src string, dst string, edge_type string")
    found = X.contradiction_edges(X.detect_conflicts(claims), nodes.repartition(4, "app_id"), edges.repartition(4, "app_id"))
    assert exchanges(found) <= 3
    got = sorted((r["app_id"] or "", r["src"], r["dst"], r["edge_type"]) for r in found.collect())
    kept = [("", "n0", "n1", "CONTAINS"), ("b", "n0", "n1", "CONTAINS"), ("b", "n0", "n1", "CONTAINS")]
    assert got == sorted([*kept, ("a", "n0", "n1", "CONTRADICTS"), ("a", "n1", "n0", "CONTRADICTS")])
