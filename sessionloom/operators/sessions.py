"""Session candidates: one summary row per session."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import models as M
from ..functions.numbers import count_true, or_unknown, round_to
from ..functions.timez import epoch_micros
from .behavior import command_counts, ev_prompt_signals, tool_totals
from .filters import main_only, nonempty_sessions
from .topk import top_per_group


def session_candidates_a(ev: DataFrame) -> DataFrame:
    """Tokens, calls, prompts, distinct models, first/last time, span in minutes and prompt signals per session."""
    rows = main_only(ev).filter(F.col("session_id") != "")
    micros = epoch_micros(F.col("ts"))
    base = rows.groupBy("session_id").agg(
        F.coalesce(F.min_by("repo", F.when(F.coalesce(F.col("repo"), F.lit("(unknown)")) != "(unknown)", F.struct("file_id", "seq"))),
                   F.lit("(unknown)")).alias("repo"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("tokens"), count_true(F.col("kind") == "tool_call").alias("tool_calls"),
        count_true(F.col("kind") == "prompt").alias("prompts"),
        F.min(micros).alias("first_us"), F.max(micros).alias("last_us"))
    models = rows.filter(F.col("total").isNotNull() & (F.col("model") != "")).groupBy("session_id").agg(
        F.count_distinct("model").alias("models"))
    signals = ev_prompt_signals(rows, "session_id").drop("prompts")
    joined = base.join(models, "session_id", "left").join(signals, "session_id", "left")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in signals.columns if c != "session_id"]
    return joined.select(
        "session_id", "repo", "tokens", "tool_calls", "prompts", F.coalesce("models", F.lit(0)).alias("models"), "first_us", "last_us",
        round_to((F.col("last_us") - F.col("first_us")) / 60000000.0, 1).alias("span_minutes"), *zero)


def session_models(ev: DataFrame) -> DataFrame:
    """Distinct (session, model) pairs."""
    return main_only(ev).filter(F.col("total").isNotNull() & (F.col("model") != "") & (F.col("session_id") != "")).select(
        "session_id", "model").distinct()


def session_candidates_b(ev: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Tokens, tool counts, span and last model per file of main-chain logs; empty sessions are dropped.

    ``facts`` (one row per file, from the headers) adds source and branch, and the repository key by the remote.
    """
    rows = main_only(ev)
    micros = epoch_micros(F.col("ts"))
    base = rows.groupBy("file_id").agg(
        F.min_by("session_id", F.when(F.col("session_id") != "", F.col("seq"))).alias("session_id"),
        F.max_by("repo", F.when(F.col("repo") != "", F.col("seq"))).alias("repo"),
        F.max_by("model", F.when(F.col("model") != "", F.col("seq"))).alias("model"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("tokens"), count_true(F.col("kind") == "prompt").alias("prompts"),
        F.floor((F.max(micros) - F.min(micros)) / 1000000).alias("duration_seconds"))
    tools = tool_totals(ev, "file_id")
    counts = [c for c in tools.columns if c != "file_id"]
    joined = base.join(tools.hint("merge"), "file_id", "left").select(*base.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    full = nonempty_sessions(joined.withColumn("tool_calls", F.col("total_calls"))).drop("total_calls")
    if facts is None:
        return full
    head = facts.select("file_id", F.col("repo").alias("_repo"), "source", "branch")
    return full.join(head.hint("merge"), "file_id", "left").withColumn("repo", F.coalesce("_repo", "repo")).drop("_repo")


def session_top_commands(ev: DataFrame, n: int = 8) -> DataFrame:
    return top_per_group(command_counts(ev, "file_id"), n, ["file_id"], "calls", "command")
