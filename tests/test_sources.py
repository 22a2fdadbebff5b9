import datetime as dt
import json
import random

import pytest
from pyspark.sql.types import StructType

from casegrid.functions.rule_catalog import builtin_rules
from casegrid.operators.community import community_nodes
from casegrid.operators.reports import latest_feedback, override_history
from casegrid.operators.versions import dependency_rows
from casegrid.sources import files, layout, sinks, tables
from casegrid.streaming import jobs


def test_json_artefacts_are_not_overwritten_unasked(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    path = str(tmp_path / "artefact")
    sinks.write_json(rows, path)
    assert sorted(tuple(r) for r in spark.read.schema(rows.schema).json(path).collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_json(rows, path)
    sinks.write_json(rows.limit(1), path, overwrite=True, partition=["k"])
    assert spark.read.json(path).count() == 1


def test_tables_grow_by_appending_and_are_read_by_key(spark, tmp_path):
    kind = tables.SCHEMAS["run_documents"]
    for rows in ([(1, 10), (2, 20)], [(1, 11)]):
        sinks.append_rows(spark.createDataFrame(rows, kind), str(tmp_path), "run_documents")
    stored = tables.read_table(spark, str(tmp_path), "run_documents")
    assert stored.count() == 3
    own = tables.for_key(stored, "run_id", 1, "document_id")
    assert [r.document_id for r in own.collect()] == [10, 11]
    assert "EqualTo(run_id,1)" in own._jdf.queryExecution().executedPlan().toString()


def test_csv_and_ground_truth_round_trip(spark, tmp_path):
    issues = spark.createDataFrame([("I-1", 'say "no", twice'), ("I-2", None)], "issue_id string, message string")
    sinks.write_csv(issues, str(tmp_path / "csv"))
    back = spark.read.option("header", True).schema(issues.schema).csv(str(tmp_path / "csv"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, issues.collect()))
    truth = spark.createDataFrame([("7", {"R1": "pass"}), ("8", {"R1": "fail"})], "submission_id string, expected_verdicts map<string,string>")
    sinks.write_ground_truth(truth, str(tmp_path / "gt"))
    assert {r.submission_id: r.expected_verdicts.R1 for r in spark.read.json(str(tmp_path / "gt")).collect()} == {7: "pass", 8: "fail"}


def test_catalogue_round_trip(spark, tmp_path):
    rules = builtin_rules(spark).select("rule_id", "rule_category", "severity", "required_fields")
    sinks.write_catalogue(rules, str(tmp_path / "cat"))
    back = files.read_catalogue(spark, str(tmp_path / "cat")).select(*rules.columns)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rules.collect()))


def test_batch_results_and_output_pairs(spark, tmp_path):
    summary = {"rule_count": 3, "pass": 1, "needs_review": 1, "fail": 1, "needs_llm": True}
    result = {"run_id": 4, "results": [{"document_id": 1, "filename": "a.pdf", "validation_summary": summary, "llm_triggered": True}, {"document_id": 1, "filename": "again.pdf"}, {"document_id": 2, "filename": "b.pdf"}]}
    (tmp_path / "batch.json").write_text(json.dumps(result))
    rows = {r.document_id: r for r in files.read_batch_results(spark, str(tmp_path / "batch.json")).collect()}
    assert (rows[1].filename, rows[1]["fail"], rows[1].llm_triggered) == ("a.pdf", 1, True) and rows[2].llm_triggered is False
    pairs = tmp_path / "out"
    pairs.mkdir()
    (pairs / "extraction_1.json").write_text(json.dumps({"fields": {"postcode": "B1"}}))
    (pairs / "validation_1.json").write_text(json.dumps({"summary": summary}))
    (pairs / "extraction_2.json").write_text(json.dumps({"fields": {}}))
    made = {r.document_id: r for r in files.read_output_pairs(spark, str(pairs)).collect()}
    assert made[1].summary.fail == 1 and made[1].fields == {"postcode": "B1"} and made[2].summary is None


def test_layout_blocks_keep_their_order(spark, tmp_path):
    data = {"text_blocks": [{"content": f"b{i}", "page_number": 1 + i // 2, "index": i} for i in range(5)], "tables": []}
    (tmp_path / "9.json").write_text(json.dumps(data))
    blocks = layout.explode_blocks(layout.read_layouts(spark, str(tmp_path)), "doc_id").orderBy("idx").collect()
    assert [(r.doc_id, r.idx, r.content, r.page_number) for r in blocks] == [(9, i, f"b{i}", 1 + i // 2) for i in range(5)]


def test_community_nodes_and_edges(spark):
    labels = spark.createDataFrame([("a", 1.0, "x", "l1"), ("a", 1.0, "y", "l1"), ("a", 1.0, "z", "l2")], "app_id string, gamma double, node_id string, label string")
    nodes, edges = community_nodes(labels)
    assert sorted(r.node_id for r in nodes.collect()) == ["community_l1", "community_l2"]
    assert {(r.src, r.dst) for r in edges.collect()} == {("x", "community_l1"), ("y", "community_l1"), ("z", "community_l2")}


def test_overrides_newest_first_and_feedback_upserts(spark):
    at = lambda h: dt.datetime(2024, 1, 1 + h // 24, h % 24)
    rows = [(i, f"c{i % 2}", at(i * 7 % 60)) for i in range(40)]
    placed = override_history(spark.createDataFrame(rows, "override_id long, check_id string, created_at timestamp")).collect()
    for check in ("c0", "c1"):
        want = [r[0] for r in sorted((r for r in rows if r[1] == check), key=lambda r: (r[2], r[0]), reverse=True)]
        assert [r.override_id for r in sorted((p for p in placed if p.check_id == check), key=lambda p: p.place)] == want
    told = [(1, 5, 1, 1, "o", True, at(1)), (2, 5, 1, 1, "o", False, at(2)), (3, 5, 1, 2, "o", True, at(1))]
    feedback = spark.createDataFrame(told, "feedback_id long, validation_check_id long, document_id long, page_number int, reviewer_id string, is_relevant boolean, created_at timestamp")
    assert {(r.page_number, r.is_relevant) for r in latest_feedback(feedback).collect()} == {(1, False), (2, True)}


def test_dependency_rows(spark):
    rules = spark.createDataFrame([("A", ["B", "C"]), ("B", ["C", "X"]), ("C", [])], "rule_id string, triggers_rules array<string>")
    assert {tuple(r) for r in dependency_rows(rules).collect()} == {
        ("A", "B", "triggers"), ("A", "C", "triggers"), ("B", "C", "triggers"), ("B", "X", "triggers"),
        ("B", "A", "triggered_by"), ("C", "A", "triggered_by"), ("C", "B", "triggered_by"),
    }


# ---- streams -------------------------------------------------------------------------------------


def drain(stream, mode, name):
    query = stream.writeStream.format("memory").outputMode(mode).queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def arriving(spark, tmp_path, rows, schema, parts=3):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_spend_guard_stream_equals_batch(spark, tmp_path):
    rows, schema = [(f"s{i % 3}", float(i)) for i in range(30)], "scope string, cost_usd double"
    drain(jobs.spend(arriving(spark, tmp_path, rows, schema), 140.0), "complete", "spend_guard_test")
    batch = jobs.spend(spark.createDataFrame(rows, schema), 140.0)
    assert sorted(spark.table("spend_guard_test").collect()) == sorted(batch.collect())
    assert {r.scope: r.over_budget for r in batch.collect()} == {"s0": False, "s1": True, "s2": True}


def test_daily_counts_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + i % 4, i % 24), "w" if i % 2 else "e") for i in range(48)]
    drain(jobs.daily_counts(arriving(spark, tmp_path, rows, "ts timestamp, severity string"), "ts", "severity"), "complete", "daily_counts_test")
    got = {(r.day.start.day, r.severity): r.n for r in spark.table("daily_counts_test").collect()}
    want = {}
    for ts, severity in rows:
        want[ts.day, severity] = want.get((ts.day, severity), 0) + 1
    assert got == want


def test_decisions_are_upserted_and_batches_may_repeat(spark, tmp_path):
    schema = "run_id long, check_id long, decision string, event_id long"
    rows = [(i % 2, i % 5, ["accept", "reject", "need_info"][i % 3], i) for i in range(60)]
    out = str(tmp_path / "out")
    log = jobs.UpsertLog(out, ["run_id", "check_id"], ["event_id"])
    write = jobs.upsert_writer(out, ["run_id", "check_id"], ["event_id"])
    query = arriving(spark, tmp_path, rows, schema).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    last = max(int(p.name.split("-")[1]) for p in (tmp_path / "out" / "length-1").iterdir())
    newest = {(run, check): (decision, event) for run, check, decision, event in rows}
    read = lambda: {(r.run_id, r.check_id): (r.decision, r.event_id) for r in log.current(spark, last, query_schema).collect()}
    query_schema = StructType.fromDDL(schema)
    assert read() == newest
    write(spark.createDataFrame(rows[-3:], schema), last)
    assert read().keys() <= newest.keys()


def test_upsert_log_merges_runs_and_survives_repeats(spark, tmp_path):
    schema = StructType.fromDDL("k long, v string, at long")
    log = jobs.UpsertLog(str(tmp_path / "log"), ["k"], ["at"], fanout=2)
    rng, state, written = random.Random(5), {}, []
    with pytest.raises(FileNotFoundError):
        log.runs(spark, 0)
    for n in range(11):
        # batch 3 is empty; keys may be null; late rows do not win; ties go to the greatest value
        rows = [] if n == 3 else [(rng.choice([None, *range(30)]), f"v{rng.randint(0, 9)}", 10 * n + rng.randint(-15, 9)) for _ in range(8)]
        written.append(rows)
        for k, v, at in rows:
            state[k] = max(state.get(k, (at, v)), (at, v))
        log.write(spark.createDataFrame(rows, schema), n)
        if n in (4, 7):  # the driver died after the batch and runs it again
            log.write(spark.createDataFrame(rows, schema), n)
        if n in (0, 3, 6, 10):
            assert {r.k: (r.at, r.v) for r in log.current(spark, n, schema).collect()} == state
    assert log.runs(spark, 10) == [(0, 8), (8, 2), (10, 1)]
    # a merged run that was cut off before it was complete is not read
    (tmp_path / "log" / "length-8" / "first-0" / "_SUCCESS").unlink()
    assert log.runs(spark, 10) == [(0, 4), (4, 4), (8, 2), (10, 1)]
    assert {r.k: (r.at, r.v) for r in log.current(spark, 10, schema).collect()} == state
    log.write(spark.createDataFrame(written[7], schema), 7)
    assert log.expire(spark, 10) == 2 + 4 + 8 + 2 and log.runs(spark, 10) == [(0, 8), (8, 2), (10, 1)]
    log.write(spark.createDataFrame(written[7], schema), 7)  # its parts are gone, its longest run is complete
    assert log.runs(spark, 10) == [(0, 8), (8, 2), (10, 1)]
    assert {r.k: (r.at, r.v) for r in log.current(spark, 10, schema).collect()} == state
    plan = log.current(spark, 10, schema).where("k = 4")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,4)" in plan
