"""Further record types of platform A logs: modes, queue operations, agents, system notes, reasoning and cache detail.

The records carry counts, times and labels only; no text of a person or a model is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.timez import parse_instant
from .logs import get, kind_of, text_at

# The record types that carry signals, to-do tools, and the keyword for longer reasoning.
TYPES = ["permission-mode", "queue-operation", "agent-name", "system", "assistant", "user"]
TODO_TOOLS = ["TodoWrite", "TaskCreate"]
KEYWORD = "(?i)ultrathink"


def number_or_null(v: Column, path: str) -> Column:
    """Whole number at a path; null when missing or not a number."""
    node = kind_of(get(v, path, "variant"))
    return F.when(node.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(node, F.lit("DECIMAL")), get(v, path, "double").cast("bigint"))


def signal_records(good: DataFrame) -> DataFrame:
    """One row per record of ``TYPES`` with the columns of its type; the others are null. Lines without a time stay."""
    r = F.col("rec")
    kind, sub = text_at(r, "$.type"), text_at(r, "$.subtype")
    blocks = F.try_variant_get(r, "$.message.content", "array<variant>")

    def of(name: str, value: Column, note: str | None = None) -> Column:
        return F.when((kind == name) if note is None else (kind == name) & (sub == note), value)

    def blocks_like(test) -> Column:
        return F.coalesce(F.size(F.filter(blocks, lambda b: F.coalesce(test(b), F.lit(False)))), F.lit(0)).cast("bigint")

    todo = blocks_like(lambda b: (text_at(b, "$.type") == "tool_use") & text_at(b, "$.name").isin(TODO_TOOLS))
    return good.filter(kind.isin(TYPES)).select(
        "file_id", F.col("line_no").alias("seq"), F.coalesce(text_at(r, "$.sessionId"), F.lit("")).alias("session_id"),
        parse_instant(text_at(r, "$.timestamp")).alias("ts"), kind.alias("type"), of("system", sub).alias("subtype"),
        of("permission-mode", text_at(r, "$.permissionMode")).alias("mode"), of("queue-operation", text_at(r, "$.operation")).alias("operation"),
        of("agent-name", text_at(r, "$.agentName")).alias("agent"),
        of("system", text_at(r, "$.compactMetadata.trigger"), "compact_boundary").alias("trigger"),
        of("system", number_or_null(r, "$.compactMetadata.preTokens"), "compact_boundary").alias("pre_tokens"),
        of("system", number_or_null(r, "$.durationMs"), "turn_duration").alias("duration_ms"),
        of("system", number_or_null(r, "$.messageCount"), "turn_duration").alias("messages"),
        of("system", get(r, "$.error.connection.code"), "api_error").alias("code"), of("system", get(r, "$.error.status"), "api_error").alias("status"),
        of("assistant", blocks_like(lambda b: text_at(b, "$.type") == "thinking")).alias("thinking_blocks"), of("assistant", todo).alias("todo_calls"),
        of("assistant", number_or_null(r, "$.message.usage.cache_creation.ephemeral_5m_input_tokens")).alias("cache_5m"),
        of("assistant", number_or_null(r, "$.message.usage.cache_creation.ephemeral_1h_input_tokens")).alias("cache_1h"),
        F.coalesce(of("user", F.rlike(text_at(r, "$.message.content"), F.lit(KEYWORD))), F.lit(False)).alias("has_keyword"))


def land_signals(signals: DataFrame, path: str) -> DataFrame:
    """Write the records in one folder per type and read them back: a reader of one type opens only its folder."""
    signals.repartition("type", F.pmod(F.xxhash64("file_id"), F.lit(16))).write.partitionBy("type").parquet(path)
    return read_signals(signals.sparkSession, path, signals)


def read_signals(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)
