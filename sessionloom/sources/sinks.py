"""Landing the event table and writing result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.timez import day_text, local_day
from ..operators.filters import in_window
from ..operators.scan import EV_WIDTH
from ..functions.timez import DayWindow


def land_ev(ev: DataFrame, path: str, by_day: bool = True) -> DataFrame:
    """Write ``ev`` once as Parquet and read it back; every operator then prunes columns and skips row groups.

    Rows are dealt by file and stretch of positions, so one large log spreads over many output files and the rows
    of a small one stay together. ``by_day`` adds day folders for window pruning; there ranges keep a day in few files.
    """
    spark = ev.sparkSession
    if not by_day:
        # by hash: ranges would be sampled first, which computes all rows twice
        ev.repartition("file_id", F.expr(f"seq div {EV_WIDTH}")).write.parquet(path)
        return spark.read.schema(ev.schema).parquet(path)
    days = ev.withColumn("day", F.to_date("ts"))
    days.repartitionByRange("day", "file_id", "seq").write.partitionBy("day").parquet(path)
    return spark.read.parquet(path)


def read_ev(spark: SparkSession, path: str, window: DayWindow | None = None, tz: str = "UTC") -> DataFrame:
    """Read a landed table; a window first prunes day folders, one day wider on both sides for other time zones."""
    ev = spark.read.parquet(path)
    if window is None:
        return ev
    if "day" in ev.columns:
        ev = ev.filter(F.col("day").between(F.date_sub(F.lit(window.first), 1), F.date_add(F.lit(window.last), 1)))
    return in_window(ev, window, tz)


def to_report_json(df: DataFrame, *keys: str) -> DataFrame:
    """One JSON document per row, keyed by ``keys``."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*rest)).alias("document"))


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Write each result table as JSON lines below ``path``; the tables are aggregates."""
    for name, df in tables.items():
        df.write.json(f"{path}/{name}")
