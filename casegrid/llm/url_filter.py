"""URL verdicts from host and path rules, by hashed expressions.

A url gives expressions: every suffix of its host at a dot, with every prefix of its path that is as long as the path
of some rule. The expressions of distinct urls are joined with the rules on the first four bytes of their digests;
whole digests confirm a match, and the longest rule (host and path) wins, then the longer host, then block.

Only Spark functions are used. Distinct urls are judged once and joined back on the url, so copies of one url cost
one judgement; rules are joined as a table of their own, and Spark decides by its measured size how.

Null urls and urls without ``://`` have an empty host and path, and no rule; so has any url no rule fits: its verdict
is the default, "allow". Rules with nulls are left out; of rules with one host and path, block wins. Repeated rows
are judged alike; other columns are kept where asked for. An empty table gives no rows; without rules all is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import require
from casegrid.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEMA = "verdict string, host string, path string"


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.concat(F.substring(url, F.instr(url, "://") + 3, F.length(url)), F.lit("#")), "#", 1))
    before_query = F.substring_index(F.concat(rest, F.lit("?")), "?", 1)
    host = F.substring_index(F.concat(before_query, F.lit("/")), "/", 1)
    path = F.substring(before_query, F.length(host) + 1, F.length(before_query))
    return F.coalesce(lowered(host), F.lit("")), F.coalesce(path, F.lit(""))


def digest(host: Column, path: Column) -> Column:
    """SHA-256 of an expression; the slash after the host is always there, so that host and path cannot be shifted."""
    return F.sha2(F.concat_ws("\n", host, path), 256)


def prepared_rules(rules: DataFrame) -> DataFrame:
    """One row per host and path: verdict, rule text, short and full digest."""
    require(rules, "verdict", "host", "path")
    clean = rules.select(F.col("verdict"), lowered(F.col("host")).alias("host"), F.col("path")).dropna()
    clean = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    return clean.select(
        "verdict",
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_length"),
        F.length("path").alias("path_length"),
        digest(F.col("host"), F.col("path")).alias("rule_digest"),
        F.substring(digest(F.col("host"), F.col("path")), 1, 8).alias("short"),
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The rows of ``pages`` with host, path, rule (null: none) and verdict; those columns are replaced if present."""
    require(pages, "url")
    book = prepared_rules(rules)
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("url").cast("string").alias("url")).dropna().distinct().select("url", host.alias("host"), path.alias("path")).filter("host != ''")

    # the distinct lengths of rule paths: at most as many as the longest rule path has characters
    lengths = F.array(*[F.lit(r[0]) for r in book.select("path_length").distinct().collect()]).cast("array<int>")
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    hosts = urls.select("url", "path", F.explode(suffixes).alias("part"))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = hosts.select("url", "part", F.explode(prefixes).alias("prefix")).select("url", digest(F.col("part"), F.col("prefix")).alias("full"))

    found = expressions.withColumn("short", F.substring("full", 1, 8)).join(book, "short").filter(F.col("full") == F.col("rule_digest"))
    order = F.struct((F.col("host_length") + F.col("path_length")).alias("n"), "host_length", "verdict", "rule")
    best = found.groupBy("url").agg(F.max(order).alias("best")).select("url", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))

    plain = pages.drop("host", "path", "rule", "verdict")
    judged = plain.join(cut_lineage(best), "url", "left")
    return judged.select(*plain.columns, host.alias("host"), path.alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
