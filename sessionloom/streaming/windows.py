"""Windowed stream aggregates. ``ev`` may be a stream or a table; ``ts`` is UTC without zone.

As streams they run in append mode: a window leaves the state, and is written once, when the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import models as M
from ..functions.numbers import count_true, ratio4
from ..functions.timez import epoch_micros
from .landing import drained

LATENESS = "1 day"


def instant(ts: Column) -> Column:
    """Event time as an instant; watermarks need one."""
    return F.timestamp_micros(epoch_micros(ts))


def with_event_time(ev: DataFrame, lateness: str = LATENESS) -> DataFrame:
    return ev.withColumn("event_time", instant(F.col("ts"))).withWatermark("event_time", lateness)


def _start(name: str) -> Column:
    return F.unix_seconds(F.col(f"{name}.start")).alias("start")


def _first_by(rows: DataFrame, key: str) -> DataFrame:
    """The first row of each key in (file, line) order."""
    first = F.row_number().over(Window.partitionBy(key).orderBy("file_id", "seq"))
    return rows.withColumn("_r", first).filter("_r = 1").drop("_r")


def usage_by_day(ev: DataFrame, key: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """Tokens per (platform, model, UTC day); ``key`` drops repeated records within the lateness bound."""
    rows = with_event_time(ev.filter(F.col("total").isNotNull()), lateness)
    rows = rows.dropDuplicatesWithinWatermark([key]) if key and ev.isStreaming else _first_by(rows, key) if key else rows
    grouped = rows.groupBy(F.window("event_time", "1 day").alias("w"), "platform", M.normalize_model(F.col("model")).alias("model"))
    return grouped.agg(F.sum("total").alias("tokens"), F.count(F.lit(1)).alias("records")).select(_start("w"), "platform", "model", "tokens", "records")


def usage_by_hour(ev: DataFrame, lateness: str = LATENESS) -> DataFrame:
    rows = with_event_time(ev.filter(F.col("total").isNotNull()), lateness)
    grouped = rows.groupBy(F.window("event_time", "1 hour").alias("w"))
    return grouped.agg(F.sum("total").alias("tokens"), F.count(F.lit(1)).alias("records")).select(_start("w"), "tokens", "records")


def activity_sessions(ev: DataFrame, gap: str = "5 minutes", *keys: str, lateness: str = LATENESS) -> DataFrame:
    """Activity runs separated by a silence of ``gap`` or longer, per key."""
    rows = with_event_time(ev.filter(F.col("total").isNotNull()), lateness)
    grouped = rows.groupBy(F.session_window("event_time", gap).alias("w"), *keys)
    agg = grouped.agg(F.count(F.lit(1)).alias("records"), F.min("event_time").alias("_a"), F.max("event_time").alias("_b"))
    return agg.select(*keys, _start("w"), "records", (F.unix_micros("_b") - F.unix_micros("_a")).alias("span_micros"))


def error_rate(ev: DataFrame, width: str = "1 hour", step: str = "15 minutes", lateness: str = LATENESS) -> DataFrame:
    rows = with_event_time(ev.filter(F.col("kind") == "tool_result"), lateness)
    errors = count_true(F.coalesce(F.col("is_error"), F.lit(False)))
    grouped = rows.groupBy(F.window("event_time", width, step).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("results"), errors.alias("errors"), ratio4(errors, F.count(F.lit(1))).alias("error_rate")).select(
        _start("w"), "results", "errors", "error_rate")


def append(stream: DataFrame, path: str, checkpoint: str) -> list[dict]:
    """Run an append-mode stream over everything available; its rows are files below ``path``, each written exactly once."""
    return drained(stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path))


def largest_state(progress: list[dict]) -> int:
    """Most rows that the operators of a query held in their state at the end of a batch."""
    return max((sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in progress), default=0)


def dropped_rows(progress: list[dict]) -> int:
    """Rows that came behind a watermark and were dropped by an operator."""
    return sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])
