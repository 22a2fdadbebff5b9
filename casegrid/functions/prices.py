"""Model price list, USD per million tokens. Fixed values, matched in this order."""

from pyspark.sql import DataFrame, SparkSession

PRICES = [
    ("gpt-4o", 2.50, 10.00),
    ("gpt-4o-mini", 0.15, 0.60),
    ("text-embedding-3-small", 0.02, 0.0),
    ("text-embedding-3-large", 0.13, 0.0),
]


def price_table(spark: SparkSession) -> DataFrame:
    rows = [(i, *price) for i, price in enumerate(PRICES)]
    return spark.createDataFrame(rows, "ord int, key string, input_price double, output_price double")
