"""The stages of the corpus pipeline: each takes documents and returns documents, the last one packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casegrid.llm.common import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the forest is fitted on labelled rows of these documents."""
    from casegrid.llm.quality_forest import keep_good

    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles."""
    from casegrid.llm.near_duplicates import keep_one

    return keep_one(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    from casegrid.llm.decontaminate import clean_documents

    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind."""
    from casegrid.llm.personal_data import mask

    return mask(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in cost-balanced sequences, with their ids."""
    from casegrid.llm.cost_packing import pack

    return pack(docs)
