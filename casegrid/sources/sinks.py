"""Sinks: JSON artefacts, appended tables, CSV, decision packages, node-link graphs, catalogues, ground truth."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.operators.reports import status_counts


def write_json(df: DataFrame, path: str, overwrite: bool = False, partition: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(*partition) if partition else writer).json(path)


def append_rows(df: DataFrame, root: str, table: str, partition: Sequence[str] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(f"{root.rstrip('/')}/{table}")


def append_jdbc(df: DataFrame, url: str, table: str, batch: int = 5000, **options: str) -> None:
    df.write.format("jdbc").mode("append").options(url=url, dbtable=table, batchsize=str(batch), **options).save()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def decision_package(submissions: DataFrame, applications: DataFrame, documents: DataFrame, checks: DataFrame) -> DataFrame:
    """Everything that backs a decision as (submission_id, section, item, payload) JSON rows.

    A package is the rows of one submission. They stay rows, so a submission with very many documents is
    written by many tasks; partition the output by submission or sort it to read one package back.
    """
    refs = applications.select(F.col("id").alias("application_id"), "application_ref")
    head = submissions.join(refs, "application_id").select(
        F.col("id").alias("submission_id"),
        F.lit("submission").alias("section"),
        F.col("id").cast("string").alias("item"),
        F.to_json(F.struct(F.col("submission_version").alias("version"), "status", "application_ref")).alias("payload"),
    )
    docs = documents.select(
        "submission_id",
        F.lit("document").alias("section"),
        F.col("document_id").alias("item"),
        F.to_json(F.struct("filename", "document_type")).alias("payload"),
    )
    found = checks.select(
        "submission_id",
        F.lit("check").alias("section"),
        F.col("check_id").alias("item"),
        F.to_json(F.struct("rule_id", "status", F.col("explanation").alias("message"))).alias("payload"),
    )
    counts = status_counts(checks, "submission_id")
    named = F.struct(F.col("pass_count").alias("pass"), F.col("fail_count").alias("fail"), F.col("needs_review_count").alias("needs_review"))
    summary = counts.select(
        "submission_id", F.lit("summary").alias("section"), F.col("submission_id").cast("string").alias("item"), F.to_json(named).alias("payload")
    )
    return head.unionByName(docs).unionByName(found).unionByName(summary)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node-link graphs as JSON lines, partitioned by application: `nodes/app_id=…` and `links/app_id=…`."""
    links = edges.withColumnRenamed("src", "source").withColumnRenamed("dst", "target")
    nodes.withColumnRenamed("node_id", "id").write.mode("overwrite").partitionBy("app_id").json(f"{path}/nodes")
    links.write.mode("overwrite").partitionBy("app_id").json(f"{path}/links")


def write_catalogue(rules: DataFrame, path: str, version: str = "1.0", source: str = "requirements") -> None:
    """Rules with their count as one JSON object in one file, on one line, sorted by their columns.

    One object is one file and so one writer: its rows are sorted on disk where they do not fit and written one by one.
    """
    columns = [c for c in rules.columns if c != "ord"]
    head = json.dumps({"version": version, "source": source, "rule_count": rules.count()})[:-1] + ', "rules": ['
    lines = rules.repartition(1).sortWithinPartitions(*columns).select(F.to_json(F.struct(*columns)).alias("value"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": [head]})
        comma = ""
        for batch in batches:
            out = []
            for line in batch.column(0).to_pylist():
                out.append(comma + line)
                comma = ","
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": ["]}"]})

    # a blank between the parts: readers of JSON lines see the object as one line
    lines.mapInArrow(joined, "value string").write.mode("overwrite").option("lineSep", " ").text(path)


def write_ground_truth(annotations: DataFrame, path: str) -> None:
    annotations.write.mode("overwrite").partitionBy("submission_id").json(path)
