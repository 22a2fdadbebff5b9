"""Registry of named queries: the Spark job, the inventory entries it covers and its SQL counterpart."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from casegrid.plans.bridge import Tables
from casegrid.plans.oracle_views import VIEWS


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None


_QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register the decorated function under its own name."""

    def wrap(build: Callable[[Tables], DataFrame]):
        _QUERIES[build.__name__] = Query(build.__name__, tuple(covers.split()), build, sql)
        return build

    return wrap


def all_queries() -> dict[str, Query]:
    from casegrid.plans import catalog  # noqa: F401  (importing registers the queries)

    return _QUERIES


def runnable(item: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return item.build(Tables(spark, sf_dir))

    return run


def _needed(sql: str) -> list[str]:
    """Names of the shared views a statement uses, dependencies first."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in found and re.search(rf"\b{name}\b", text):
                visit_name(name)

    def visit_name(name: str) -> None:
        for other in VIEWS:
            if other != name and other not in found and re.search(rf"\b{other}\b", VIEWS[name]):
                visit_name(other)
        if name not in found:
            found.append(name)

    visit(sql)
    return found


def full_sql(item: Query) -> str | None:
    """The statement with the shared views it needs as leading CTEs."""
    if item.sql is None:
        return None
    body = item.sql.strip()
    views = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in _needed(body))
    if not views:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{body[14:]}"
    if body.upper().startswith("WITH"):
        return f"WITH {views},\n{body[4:]}"
    return f"WITH {views}\n{body}"
