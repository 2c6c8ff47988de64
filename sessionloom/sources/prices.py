"""Price dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.models import PRICES

SCHEMA = "prefix string, input bigint, cached_input bigint, output bigint, cache_creation bigint"


def price_table(spark: SparkSession) -> DataFrame:
    """Fallback prices by model prefix in nano-dollars per token."""
    rows = [(p, *[None if x is None else round(x * 1000) for x in rates]) for p, rates in PRICES.items()]
    return spark.createDataFrame(rows, SCHEMA)


def official_prices(spark: SparkSession, path: str) -> DataFrame:
    """Prices by exact model name from a JSON-lines file: name, input, cached_input, output, cache_creation (dollars per million)."""
    return spark.read.schema(
        "name string, input double, cached_input double, output double, cache_creation double, source string").json(path).filter(
        F.col("name").isNotNull())
