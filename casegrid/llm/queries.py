"""Registered queries of the text operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.llm import oracles
from casegrid.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op3_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegrid.llm.binary_packing import pack_binary

    return pack_binary(table(spark, sf_dir, "documents"))


@query
def op7_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegrid.llm.cost_packing import pack, piece_digests

    return piece_digests(pack(table(spark, sf_dir, "documents")))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegrid.llm.decontaminate import find_passages, passage_digests

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return passage_digests(find_passages(docs, table(spark, sf_dir, "benchmark"), keep_text=False))


@query
def op6_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegrid.llm.quality_forest import judged_documents

    judged = judged_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegrid.llm.near_duplicates import find_groups

    return find_groups(table(spark, sf_dir, "documents"), width=4)


@query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegrid.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: The rules that the url contract names.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query
def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegrid.llm import url_filter

    rules = spark.createDataFrame(URL_RULES, url_filter.SCHEMA)
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL["op5_url_rules"] = """
WITH rules(verdict, h, p) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), parts AS (
  SELECT row_number() OVER () AS row_id, page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), cut AS (
  SELECT row_id, page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM parts
), named AS (
  SELECT row_id, page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
  FROM cut
), ranked AS (
  SELECT n.row_id, n.page_id, n.host, n.path, r.h || r.p AS rule, r.verdict,
         row_number() OVER (PARTITION BY n.row_id ORDER BY length(r.h || r.p) DESC NULLS LAST, length(r.h) DESC) AS place
  FROM named n LEFT JOIN rules r
    ON (n.host = r.h OR ends_with(n.host, '.' || r.h)) AND starts_with(n.path, r.p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE place = 1
"""


@query
def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegrid.llm.personal_data import find, span_digests

    return span_digests(find(table(spark, sf_dir, "documents")))


@query
def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegrid.llm.site_bayes import judge_sites

    return judge_sites(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegrid.llm.toxicity import judge, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    categories = {"low_quality": F.lit(1) - F.col("quality"), "toxic": F.col("toxic")}
    judged = judge(docs, train(docs, labels, categories), list(categories))
    return judged.withColumnRenamed("marked", "toxic")


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegrid.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings")).drop("deviation_digits")


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegrid.llm.prefix_trie import crossed, prefix_trie, turn_lists

    return prefix_trie(crossed(turn_lists(table(spark, sf_dir, "conversations"))))


@query
def op12_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegrid.llm.genetic_packing import pack, piece_digests

    return piece_digests(pack(table(spark, sf_dir, "documents")))


ORACLE_SQL["op4_near_duplicates"] = oracles.NEAR_DUPLICATES
ORACLE_SQL["op9_decontamination"] = oracles.DECONTAMINATION
ORACLE_SQL["op11_prefix_trie"] = oracles.PREFIX_TRIE
