"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from casegrid.plans.registry import all_queries, runnable
from casegrid.session import build_session

HEADLINE = [
    "case_list",
    "change_items",
    "best_fields",
    "conflict_options",
    "run_history",
    "version_finding_changes",
    "rule_findings",
    "conflicts",
    "parent_discovery",
    "extracted_fields",
    "extraction_to_findings",
    "token_chunks",
    "graph_edges",
    "issue_states",
]


def laid_out(spark, sf_dir: str, parts: int) -> str:
    """The tables again, each in ``parts`` files: a file of a single row group is one task however many cores there are.

    Tables of real size come in many row groups; this step is timed and counted as ``layout``.
    """
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    folder = tempfile.mkdtemp(prefix="bench-")
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            spark.read.parquet(f"{sf_dir}/{name}").repartition(parts).write.parquet(f"{folder}/{name}")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "20g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    timings: dict[str, float] = {}
    start = time.time()
    tables = laid_out(spark, sf_dir.rstrip("/"), int(cpus))
    timings["layout"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        runnable(registered[name])(spark, tables).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
