"""Numbering in hot keys, versions, rules, lineage, streams and sources."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from casegrid.functions.rule_catalog import builtin_rules
from casegrid.operators import lineage as L
from casegrid.operators import rules as V
from casegrid.operators import versions as D
from casegrid.operators.ordered import global_running_sum, number_within, running_sum
from casegrid.sources import files as S
from casegrid.sources import sinks
from casegrid.sources.tables import SCHEMAS, domain_violations, read_table, schema_of
from casegrid.streaming import jobs as J


@pytest.fixture(scope="module")
def hot(spark):
    rows = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)))
    return rows.withColumn("ts", F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(30_000_000)))).withColumn("v", F.col("id") % 7)


def test_number_and_previous_equal_plain_windows(hot):
    w = Window.partitionBy("k").orderBy("ts", "id")
    plain = hot.select("id", F.row_number().over(w).cast("long").alias("n"), F.lag("id").over(w).alias("p"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    ours = number_within(hot, ["k"], ["ts", "id"], F.date_trunc("month", "ts"), number="n", previous={"p": "id"}).select("id", F.col("n").cast("long").alias("n"), "p")
    sums = running_sum(hot, ["k"], ["ts", "id"], F.date_trunc("month", "ts"), "v", "s").select("id", "s")
    both = ours.join(sums, "id")
    assert both.exceptAll(plain).isEmpty() and plain.exceptAll(both).isEmpty()


def test_global_running_sum(hot):
    w = Window.orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = hot.select("id", F.sum("v").over(w).alias("s"))
    assert global_running_sum(hot, ["ts", "id"], "v", "s").select("id", "s").exceptAll(plain).isEmpty()


@pytest.mark.parametrize(
    "item, score",
    [
        (None, 0.0),
        (("field_delta", "site_address", None, "modified"), 0.9),
        (("field_delta", "postcode", None, "modified"), 0.5),
        (("field_delta", "colour", None, "modified"), 0.2),
        (("document_delta", None, "site_plan", "replaced"), 0.6),
        (("document_delta", None, "site_plan", "added"), 0.4),
        (("spatial_metric_delta", "building_height", None, "modified"), 0.7),
    ],
)
def test_significance(spark, item, score):
    pairs = spark.createDataFrame([(2, 1)], "submission_id long, parent_id long")
    items = spark.createDataFrame([(2, *item)] if item else [], "submission_id long, change_type string, field_key string, document_type string, action string")
    row = D.change_sets(pairs, items).first()
    assert row.significance_score == score
    assert row.requires_validation == ("yes" if score > 0.3 else "partial" if score > 0.1 else "no")


def test_rule_cascade(spark):
    rules = spark.createDataFrame(
        [("A", ["f"], {}, ["B"]), ("B", [], {}, ["C"]), ("C", [], {}, ["A"]), ("D", [], {"f": "low"}, [])],
        "rule_id string, required_fields array<string>, dependent_fields map<string,string>, triggers_rules array<string>",
    )
    changes = spark.createDataFrame([("s", "f")], "key string, field string")
    assert {r.rule_id for r in D.cascade_rules(changes, rules).collect()} == {"A", "B", "C"}
    assert {r.rule_id for r in D.cascade_rules(changes, rules, threshold=0.1).collect()} == {"A", "B", "C", "D"}


def test_new_rule_category(spark):
    V.register_rule_category("SHOUTING", lambda: F.when(F.col("fields")["t"] == F.upper(F.col("fields")["t"]), V.finding("fail", "loud")).otherwise(V.finding("pass", "calm")))
    try:
        subjects = spark.createDataFrame([("d", 1, "letter", "", {"t": "HEY"})], "document_id string, submission_id long, document_type string, application_type string, fields map<string,string>")
        rule = builtin_rules(spark).where("rule_id = 'R-MOD-001'").withColumn("rule_category", F.lit("shouting"))
        assert V.evaluate_rules(subjects, None, rule).first().status == "fail"
        unknown = rule.withColumn("rule_category", F.lit("NOPE"))
        assert V.evaluate_rules(subjects, None, unknown).count() == 0
    finally:
        V._CATEGORIES.pop("SHOUTING")


def test_containing_pairs(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1 ") for _ in range(rng.randint(1, 14))) for _ in range(120)]
    df = spark.createDataFrame([(x,) for x in set(texts)], "t string")
    got = {(r.target, r.candidate) for r in L.containing_pairs(df.select(F.col("t").alias("target")), df.select(F.col("t").alias("candidate")), gram=4).collect()}
    assert got == {(a, b) for a in set(texts) for b in set(texts) if a in b}


def test_an_address_that_very_many_contain_is_read_in_parts(spark):
    rng = random.Random(4)
    texts = [f"{rng.randint(1, 900)} high street{rng.choice(['', ', flat b', ' north'])}" for _ in range(3000)] + ["high street", "low road", "", None]
    rows = [(i, x, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 400))) for i, x in enumerate(texts)]
    rows[7] = (7, rows[7][1], None)
    applications = spark.createDataFrame(rows, "id long, site_address string, created_at timestamp")
    wanted = [3000, 3001, 3002, 3003, 5, 6, 7]
    targets = applications.where(F.col("id").isin(wanted)).select(F.col("id").alias("target_id"), F.col("site_address").alias("address"))
    newest = lambda i: (rows[i][2] or dt.datetime(1, 1, 1), i)
    ratio = lambda a, b: round(200.0 * len(a) / (len(a) + len(b))) / 100
    found = {t: [i for i, x in enumerate(texts) if x and texts[t] and i != t and texts[t] in x] for t in wanted}

    got = L.address_matches(targets, applications, 10).collect()
    assert sorted((r.target_id, r["rank"], r.application_id) for r in got) == sorted(
        (t, n + 1, i) for t, ids in found.items() for n, i in enumerate(sorted(ids, key=newest, reverse=True)[:10])
    )
    best = {r.target_id: r.application_id for r in L.closest_addresses(targets, applications, 0.0).collect()}
    assert best == {t: max(ids, key=lambda i: (ratio(texts[t], texts[i]), *newest(i))) for t, ids in found.items() if ids}

    distinct = applications.select(F.col("site_address").alias("candidate")).where("candidate is not null").distinct()
    lone = spark.createDataFrame([("high street",)], "target string")
    pairs = L.containing_pairs(lone, distinct, split_rows=100)
    assert {r.candidate for r in pairs.collect()} == {x for x in texts if x and "high street" in x}
    plan = L.address_matches(targets, applications)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def brute_throttle(times, window, most):
    sent, out = [], []
    for at in times:
        sent = [s for s in sent if s > at - window]
        ok = len(sent) < most
        if ok:
            sent.append(at)
        out.append(ok)
    return out


def alerts_frame(spark, times):
    return spark.createDataFrame([("x", i, t) for i, t in enumerate(times)], "limiter string, alert_id long, second long").select(
        "limiter", "alert_id", F.timestamp_seconds("second").alias("ts")
    )


def test_throttle_batch_and_stream(spark, tmp_path):
    rng = random.Random(9)
    times, now = [], 0
    for _ in range(400):
        now += rng.choice([0, 1, 2, 5, 40, 70])
        times.append(now)
    expected = brute_throttle(times, 60, 4)
    frame = alerts_frame(spark, times)
    assert [r.sent for r in J.throttle(frame, 60, 4).orderBy("alert_id").collect()] == expected
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = J.throttle_stream(stream, 60, 4).writeStream.format("memory").queryName("throttled").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [r.sent for r in spark.table("throttled").orderBy("alert_id").collect()] == expected


def test_issue_states_stream_equals_batch(spark, tmp_path):
    kinds = ["document_upload", "option_selection", "explanation_provided", "dismissed", "recheck"]
    rng = random.Random(1)
    rows = [(i, rng.randint(1, 9), i * 10, k, rng.choice(["resolved", "open"]) if k == "recheck" else None) for i, k in enumerate(rng.choices(kinds, k=80))]
    frame = spark.createDataFrame(rows, "action_id long, issue_id long, s long, action_type string, new_status string").select(
        "action_id", "issue_id", F.timestamp_seconds("s").alias("ts"), "action_type", "new_status"
    )
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = J.live_issue_states(stream).writeStream.format("memory").queryName("issues").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("issues").collect())) == sorted(map(tuple, J.live_issue_states(frame).collect()))


def test_first_arrivals_stream(spark, tmp_path):
    frame = spark.createDataFrame([("h1", 10), ("h1", 20), ("h2", 30)], "content_hash string, s long").select("content_hash", F.timestamp_seconds("s").alias("uploaded_at"))
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = J.first_arrivals(stream).writeStream.format("memory").queryName("arrivals").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.content_hash for r in spark.table("arrivals").collect()) == ["h1", "h2"]


def test_layout_stream_to_findings(spark, tmp_path):
    from tests.test_extract import FORM, NOTICE, layouts

    frame = layouts(spark, FORM, NOTICE)
    frame.write.json(str(tmp_path / "in"))
    rules = builtin_rules(spark)
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(frame.schema).json(str(tmp_path / "in"))
    started = J.stream_findings(stream, rules, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "ckpt")).start()
    started.processAllAvailable()
    started.stop()
    columns = ["document_id", "rule_id", "status"]
    got = sorted(map(tuple, spark.read.parquet(out).select(columns).collect()))
    assert got == sorted(map(tuple, J.findings_for(frame, rules).select(columns).collect())) and got


def test_requirements_and_catalogue(spark, tmp_path):
    text = "preamble\nRULE-1: Site address\nMust be there.\nRequired fields: site_address, postcode; x\nSeverity: warning\nFields: a|b\n2) Plans\nCategory: consistency\nTags: t\n"
    (tmp_path / "req.md").write_text(text)
    rules = {r.rule_id: r for r in S.read_requirements(spark, str(tmp_path / "req.md")).collect()}
    assert rules["R1"].required_fields == ["a", "b"] and rules["R1"].severity == "warning" and rules["R1"].description == "Must be there."
    assert rules["R1"].source_types == ["unknown"] and rules["R2"].rule_category == "CONSISTENCY" and rules["R2"].title == "Plans"
    catalogue = {"rules": [{"rule_id": "Z", "evidence": {"keywords": ["k"]}}]}
    (tmp_path / "cat.json").write_text(json.dumps(catalogue))
    row = S.read_catalogue(spark, str(tmp_path / "cat.json")).first()
    assert (row.rule_category, row.severity, row.keywords, row.min_confidence) == ("FIELD_REQUIRED", "error", ["k"], 0.6)


def test_files_truth_and_labels(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "b.PDF").write_bytes(b"yy")
    (tmp_path / "c.txt").write_bytes(b"x")
    assert sorted(r.length for r in S.read_documents(spark, str(tmp_path)).collect()) == [1, 2]
    listed = spark.createDataFrame([("a.pdf", 0), ("a.doc", 5), ("B.PDF", S.LARGE_FILE + 1)], "path string, length long")
    assert [r.admit_status for r in S.admitted(listed).collect()] == ["rejected_empty", "rejected_type", "large"]
    truth = tmp_path / "truth"
    truth.mkdir()
    (truth / "gt_1.json").write_text(json.dumps({"submission_id": 1, "expected_verdicts": {"R1": "pass"}}))
    (truth / "gt_2.json").write_text("{broken")
    assert [tuple(r) for r in S.expected_verdicts(S.read_ground_truth(spark, str(truth))).collect()] == [("1", "R1", "pass")]
    labels = spark.createDataFrame([(json.dumps({"d1": {"source": "bcc_real"}, "d2": {"source": "synthetic", "variation": "v"}}),)], "value string")
    got = {(r.measure, r["name"]): r.n for r in S.label_summary(S.parse_labels(labels)).collect()}
    assert got == {("total", "all"): 2, ("source", "bcc_real"): 1, ("source", "synthetic"): 1, ("variation", "v"): 1}
    assert S.read_graph_table(spark, str(tmp_path), "communities").count() == 0


def test_graph_files_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "x", "Room")], "app_id string, node_id string, node_type string")
    edges = spark.createDataFrame([("a", "x", "x", "CONTAINS")], "app_id string, src string, dst string, edge_type string")
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g/nodes")).first().id == "x"
    (tmp_path / "app9.json").write_text(json.dumps({"nodes": [{"id": "n", "node_type": "Room"}], "links": [{"source": "n", "target": "n"}]}))
    n, e = S.read_node_link(spark, str(tmp_path / "app9.json"))
    assert n.first().app_id == "app9" and e.count() == 1
    sinks.write_catalogue(builtin_rules(spark), str(tmp_path / "cat"))
    assert spark.read.json(str(tmp_path / "cat")).first().rule_count == 30


def test_schemas_parse_and_domains(spark, tmp_path):
    assert all(schema_of(name).fields for name in SCHEMAS)
    row = spark.createDataFrame([(1, "a", "Z")], "id long, original_status string, override_status string")
    assert domain_violations(row, "officer_overrides").count() == 1
    spark.createDataFrame([(1, 2)], SCHEMAS["run_documents"]).write.parquet(str(tmp_path / "run_documents"))
    assert read_table(spark, str(tmp_path), "run_documents").first().document_id == 2


def test_rule_dependencies(spark):
    rules = spark.createDataFrame(
        [("A", ["B", "C"], {}, []), ("B", ["C"], {}, []), ("C", [], {}, [])],
        "rule_id string, triggers_rules array<string>, dependent_fields map<string,string>, required_fields array<string>",
    )
    got = {r.rule_id: r.triggered_by_rules for r in D.rule_dependencies(rules).collect()}
    assert got == {"A": [], "B": ["A"], "C": ["A", "B"]}


def test_the_matches_of_all_targets_are_never_sorted(spark):
    # targets and applications that come twice or more, also under one id with other addresses, and without an id
    streets = ["high street", "1 high street", "21 high street", "low road", "2 low road"]
    rows = [(k % 23 if k % 11 else None, streets[k * 7 % 5], dt.datetime(2024, 1, 1) + dt.timedelta(hours=k * 5 % 17)) for k in range(60)]
    rows += [(99, "high street", dt.datetime(2025, 1, 1))] * 13
    applications = spark.createDataFrame(rows, "id long, site_address string, created_at timestamp")
    targets = applications.select(F.col("id").alias("target_id"), F.col("site_address").alias("address"))
    newest = lambda r: (r[2], -1 if r[0] is None else r[0])
    want = set()
    for t in {r[0] for r in rows} - {None}:
        met = [r for own in rows if own[0] == t for r in sorted((r for r in rows if own[1] in r[1]), key=newest, reverse=True)[:4]]
        met = sorted((r for r in met if r[0] is not None and r[0] != t), key=newest, reverse=True)[:3]
        want |= {(t, n + 1, r[0]) for n, r in enumerate(met)}
    found = L.address_matches(targets, applications, 3)
    got = [(r.target_id, r["rank"], r.application_id) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(target_id" not in plan
