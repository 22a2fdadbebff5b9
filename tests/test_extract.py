"""Golden layouts and single extractors."""

import json

from pyspark.sql import functions as F

from casegrid.functions import patterns as P
from casegrid.operators import extract as E
from casegrid.operators import gate as G
from casegrid.sources.layout import BLOCK, all_text, blob_location, explode_cells, read_layouts, unify_keys

FORM = [
    "Application form", "Site location", "Property Name: Unit M", "Address Line 1: Dorset Road", "Address Line 2: Saltley Business Park",
    "Town/City: Birmingham", "Postcode: B8 1BG", "I/We hereby apply for Prior Approval: Prior Approval", "Applicant Name: Daniel Green",
    "planning.registration@birmingham.gov.uk", "0121 464 3669",
]
NOTICE = [
    "Statement of Display of a Site Notice", "Demolition of Unit M, Dorset Road, Saltley Business Park, B8 1BG", "Site Notice",
    "planning.registration@birmingham.gov.uk", "0121 464 3669", "Contact: Birmingham City Council",
]
PLAN = ["Site plan 1:1250", "North Arrow", "0 5 10 15 20m", "Drawing No: P-12/A Rev: b", "Site area 2.5 ha", "Ridge 8.5m and floor area 1,200 sqm"]


def layouts(spark, *documents):
    rows = [(i, [(text, 1, n, None, None) for n, text in enumerate(lines)]) for i, lines in enumerate(documents)]
    return spark.createDataFrame(rows, f"doc_id long, text_blocks array<{BLOCK}>")


def fields_of(spark, lines):
    rows = E.field_rows(E.extract(layouts(spark, lines), ["doc_id"]), ["doc_id"]).collect()
    return {r.field_name: (r.value, r.confidence) for r in rows}


def test_application_form(spark):
    got = fields_of(spark, FORM)
    assert got["document_type"][0] == "application_form"
    assert got["site_address"] == ("Unit M, Dorset Road, Saltley Business Park, Birmingham, B8 1BG", 0.95)
    assert got["postcode"] == ("B8 1BG", 0.9)
    assert got["applicant_name"] == ("Daniel Green", 0.7)
    assert "applicant_email" not in got and "applicant_phone" not in got
    assert got["is_signed"][0] == "False" and got["exemption_claimed"][0] == "False"


def test_site_notice(spark):
    got = fields_of(spark, NOTICE)
    assert got["document_type"][0] == "site_notice"
    assert got["site_address"] == ("Unit M, Dorset Road, Saltley Business Park, B8 1BG", 0.85)
    assert got["postcode"] == ("B8 1BG", 0.5)
    assert "certificate_type" not in got


def test_plan_metadata(spark):
    got = fields_of(spark, PLAN)
    assert got["document_type"][0] == "site_plan"
    assert got["scale_ratio"] == ("1:1250", 0.9)
    assert got["north_arrow_present"] == ("True", 0.8)
    assert got["scale_bar_present"] == ("True", 0.8)
    assert got["drawing_number"] == ("P-12/A", 0.8)
    assert got["revision"] == ("B", 0.8)
    assert got["plan_type"][0] == "location_plan"


def test_measurements_and_largest_area(spark):
    found = E.measurement_rows(E.extract(layouts(spark, PLAN), ["doc_id"]), ["doc_id"]).collect()
    values = {(r.value, r.unit) for r in found}
    assert {(2.5, "ha"), (8.5, "m"), (1200.0, "sqm"), (20.0, "m")} <= values
    assert fields_of(spark, PLAN)["site_area_sqm"][0] == "25000.0"


def test_whole_documents_are_read(spark):
    late = ["plain line"] * 420 + ["Our ref PP-1234567"]
    assert fields_of(spark, late)["application_ref"] == ("PP-1234567", 0.9)


def test_label_value_in_next_blocks(spark):
    got = fields_of(spark, ["Description of the proposal", "Rear extension", "with a new pitched roof over it"])
    assert got["proposal_description"][0] == "Rear extension with a new pitched roof over it"


def test_evidence_has_block_ids(spark):
    rows = E.evidence_rows(E.extract(layouts(spark, NOTICE), ["doc_id"]), ["doc_id"]).where("field_name = 'postcode'").collect()
    assert [(r.block_id, r.page, r.source_doc_type) for r in rows] == [("p1b1", 1, "site_notice")]


def test_layout_json_with_old_keys_and_tables(spark, tmp_path):
    data = {
        "text_blocks": [{"text": "Site notice", "page": 2}],
        "tables": [{"page_number": 2, "cells": [{"row_index": 0, "column_index": 0, "content": "cell"}]}],
    }
    (tmp_path / "layout_7.json").write_text(json.dumps(data))
    read = read_layouts(spark, str(tmp_path))
    row = read.select("doc_id", all_text(F.col("text_blocks"), F.col("tables")).alias("text")).first()
    assert (row.doc_id, row.text) == (7, "Site notice\ncell")
    assert explode_cells(read, "doc_id").first().content == "cell"
    assert unify_keys(read.select("doc_id", "text_blocks").withColumn("text_blocks", F.expr("transform(text_blocks, b -> named_struct('content', b.content, 'text', b.content, 'page_number', b.page_number, 'page', b.page_number, 'index', b.index, 'role', b.role, 'bounding_box', b.bounding_box))"))).count() == 1


def test_single_field_checks(spark):
    lines = ["Site address: 12 High Street, Leeds", "Proposed use: dwelling", "Application ref: X/1"]
    rows = {r.field_name: r for r in G.single_field_checks(layouts(spark, lines), "doc_id").collect()}
    assert rows["site_address"].status == "pass" and rows["site_address"].evidence_page == 1
    assert rows["application_ref"].status == "fail" and rows["application_ref"].confidence == 0.5
    assert rows["proposed_use"].extracted_value == "dwelling"


def test_blob_location(spark):
    df = spark.createDataFrame([("azure://a/box/x/y.json",), ("azure://a/box",), ("s3://q",)], "uri string")
    assert [tuple(r) for r in blob_location(df, "uri").select("container", "blob_path").collect()] == [("box", "x/y.json"), (None, None), (None, None)]


def test_responses_fill_gaps_only(spark):
    own = spark.createDataFrame([(1, "a", "x", 0.4)], "document_id long, field_name string, value string, confidence double")
    given = spark.createDataFrame([(1, "a", "y", 0.9), (1, "b", "z", 0.8), (1, "c", "", 0.9)], own.schema)
    got = {r.field_name: (r.value, r.origin) for r in G.apply_responses(own, given).collect()}
    assert got == {"a": ("x", "extraction"), "b": ("z", "resolver")}


def test_resolver_status(spark):
    df = spark.createDataFrame([("v", 0.7), ("v", 0.6), (None, 0.9)], "v string, c double")
    assert [r[0] for r in df.select(G.resolver_status(F.col("v"), F.col("c"))).collect()] == ["pass", "needs_review", "fail"]


def test_long_documents_stay_linear(spark):
    """A block of many lines and a document of many pages; both took quadratic time before."""
    import time

    from casegrid.operators.gate import keyword_value, label_entries
    from casegrid.sources.layout import page_texts
    from pyspark.sql import functions as F

    lines = "\n".join(f"label {i}:\nvalue {i}" for i in range(5000))
    one = layouts(spark, [lines]).select("*", label_entries(F.col("text_blocks")).alias("e"))
    start = time.time()
    row = one.select(F.size("e").alias("n"), F.element_at("e", -1).alias("last"), keyword_value("label_4999", F.col("e"), F.col("text_blocks")).alias("v")).first()
    assert row.n == 5000 and row["last"].value == "value 4999" and row.v == "value 4999"
    block = F.struct(F.concat(F.lit("text "), F.col("id")).alias("content"), (F.floor(F.col("id") / 10) + 1).alias("page_number"), F.col("id").alias("index"))
    many = spark.range(20_000).groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("o"), block.alias("b")))).alias("x"))
    whole = many.select(F.lit(1).alias("doc_id"), F.transform("x", lambda x: x["b"]).alias("text_blocks"))
    pages = {r.page_number: r.text for r in page_texts(whole, "doc_id").collect()}
    assert len(pages) == 2000 and pages[2000].split("\n") == [f"text {i}" for i in range(19_990, 20_000)]
    assert time.time() - start < 60


def test_document_evidence_shows_the_first_snippets_of_every_kind(spark):
    # the second row repeats the id of the first, the third has no id
    docs = [(0, ["", "a" * 120, *[f"line {n}" for n in range(9)]]), (0, ["other", "Ridge 8.5m", "Ridge 9.5m", "Ridge 7.5m", "Ridge 6.5m"]), (None, ["alone"])]
    rows = [(i, [(text, 1 + n // 4, n, None, None) for n, text in enumerate(lines)], [(1, 2, 3, [(0, 0, "c", "x"), (0, 1, "d", "x")])]) for i, lines in docs]
    cells = "array<struct<row_count:long,column_count:long,page_number:long,cells:array<struct<row_index:long,column_index:long,content:string,kind:string>>>>"
    frame = spark.createDataFrame(rows, f"doc_id long, text_blocks array<{BLOCK}>, tables {cells}")
    evidence = E.document_evidence(frame, E.extract(frame, ["doc_id"]), ["doc_id"])
    got = {(r.doc_id, r.evidence_type): r for r in E.evidence_summary(evidence, ["doc_id"]).collect()}
    text, table, alone = got[0, "text_block"], got[0, "table"], got[None, "text_block"]
    assert (text.rows, text.pages, text.snippets) == (16, 3, ["other", "Ridge 8.5m", "a" * 100 + "...", "Ridge 9.5m", "line 0"])
    assert (table.rows, table.pages, table.snippets) == (2, 1, ["c | d", "c | d"])
    assert (alone.rows, alone.pages, alone.snippets) == (1, 1, ["alone"])
    measured = evidence.where("evidence_type = 'field' AND evidence_key = 'measurements'").collect()
    assert len(measured) == 4 and all(r.early for r in measured)
    assert 0 < len(got[0, "field"].snippets) <= 5


def test_the_query_of_document_evidence_gives_snippets(spark, tmp_path):
    from casegrid.plans.bridge import Tables
    from casegrid.plans.registry import all_queries

    spark.createDataFrame([(6, "first line\nsecond line", "en", "web", 22)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.evidence_type: r for r in all_queries()["document_evidence"].build(Tables(spark, str(tmp_path))).collect()}
    assert got["text_block"].snippets[0].startswith("Application Form") and len(got["text_block"].snippets) == 5
    assert got["text_block"].rows > 5 and got["field"].snippets
