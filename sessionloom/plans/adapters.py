"""Views of the given tables in the shape of session events.

``events_wide`` keeps one row per event; ``events_as_ev`` explodes it into the ``ev`` contract, one row per
prompt, usage record, call, result, edit, label or marker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import models, numbers, prompts, text
from ..schema import STRIDE, as_ev
from ..session import new_path
from ..sources.sinks import land_ev
from . import corpus as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with long texts."""
    return table(spark, sf_dir, name)


def pick(values: list[str], index: Column) -> Column:
    """The list entry at ``index`` modulo the list length."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def plan_cache(build):
    """Keep the lazy plan per session and folder; no rows are kept in memory."""
    plans: dict[tuple, DataFrame] = {}

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, id(spark), sf_dir)
        if key not in plans:
            plans[key] = build(spark, sf_dir)
        return plans[key]

    return get


@plan_cache
def events_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(table(spark, sf_dir, "events"))


@plan_cache
def events_dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``events_wide``, dealt evenly over the tasks; for what is built row by row and written."""
    events = table(spark, sf_dir, "events")
    # a file's few row groups would each be one task, and the files written one task each for every reader behind
    return _wide(events.repartition(*events.columns))


def _wide(events: DataFrame) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    k, model = F.col("k"), F.col("model")
    claude = F.startswith(model, F.lit("claude"))
    base = events.select(
        "event_id", "ts", "user_id", "event_type",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.floor(F.col("value") * 100).cast("bigint").alias("input"),
        pick(C.MODELS, F.col("event_id")).alias("model"),
    )
    wide = base.select(
        "*",
        F.concat(F.lit("f"), F.col("user_id"), F.lit("-"), F.weekofyear("ts")).alias("file_id"),
        F.concat(F.lit("s"), F.col("user_id")).alias("session_id"),
        F.concat(F.lit("repo"), k % 20).alias("repo"),
        F.concat(F.lit("b"), e % 3).alias("branch"),
        (k % 17 == 0).alias("is_sidechain"),
        F.when(claude, F.lit("A")).otherwise(F.lit("B")).alias("platform"),
        F.expr("input * (k % 10) div 10").alias("cached_input"),
        (e % 1000).alias("output"),
        F.when(claude, F.lit(0)).otherwise(F.expr("(event_id % 1000) div 4")).cast("bigint").alias("reasoning_output"),
        F.when(claude, k).otherwise(F.lit(0)).cast("bigint").alias("cache_creation"),
        F.when(kind == "click", F.lit("Bash"))
        .when(kind == "purchase", F.when(k % 3 != 0, F.lit("Edit")).otherwise(F.lit("Read")))
        .when(kind == "view", F.when(k % 5 == 0, F.concat(F.lit("mcp__srv"), k % 3, F.lit("__tool"), k % 4))
              .when(k % 5 == 1, F.lit("WebSearch")).when(k % 5 == 2, F.lit("Task")).otherwise(F.lit("Grep")))
        .when(kind == "error", pick(C.RESULT_TOOLS, k)).alias("tool_name"),
        pick(C.EXTENSIONS, k).alias("ext0"),
        F.when(kind == "click", pick(C.COMMANDS, e)).alias("command"),
        F.when(kind == "signup", pick(C.PROMPTS, e)).alias("prompt_text"),
        F.when(kind == "error", pick(C.ERRORS, e)).alias("error_text"),
        F.when(e % 4 == 0, pick(C.SOURCES, F.col("user_id"))).otherwise(F.lit("")).alias("source"),
        pick(C.LABEL_FIELDS, e).alias("label_field"),
        F.when(k % 3 == 1, F.lit("plus")).when(k % 3 == 2, F.lit("pro")).alias("plan"),
    )
    is_tool = kind.isin("view", "click", "purchase")
    label = None
    for field in C.LABEL_FIELDS:
        hit, value = F.col("label_field") == field, pick(C.LABELS[field], F.col("k"))
        label = F.when(hit, value) if label is None else label.when(hit, value)
    side = F.col("is_sidechain")
    return wide.select(
        "*",
        F.when(claude, F.col("input") + F.col("cached_input") + F.col("output") + F.col("cache_creation"))
        .otherwise(F.col("input") + F.col("output")).alias("total"),
        F.when(is_tool, text.tool_kind(F.col("tool_name"))).alias("tool_kind"),
        ((kind == "purchase") & (k % 3 != 0)).alias("is_edit"),
        F.when(kind == "purchase", F.concat(F.lit("file"), k % 7, F.lit("."), F.col("ext0"))).alias("file_base"),
        F.when(kind == "purchase", F.col("ext0")).alias("file_ext"),
        ((kind == "error") & (k % 4 != 0)).alias("is_error"),
        ((kind == "signup") & ~side & prompts.is_human_prompt(F.col("prompt_text"), F.lit(False))).alias("is_boundary"),
        label.alias("label"),
        F.when(side, F.lit("subagent")).when(k % 23 == 1, F.lit("compaction")).when(k % 29 == 2, F.lit("abort"))
        .when(k % 31 == 3, F.lit("attachment")).when(k % 37 == 4, F.lit("api_error"))
        .when((kind == "error") & (k % 9 == 1), F.lit("interrupt")).alias("marker"),
    )


@plan_cache
def events_as_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``events`` table as ``ev``, landed once per session and folder below the shared folder."""
    return land_ev(explode_events(spark, sf_dir), new_path(spark, "ev"), by_day=False)


def explode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events_dealt(spark, sf_dir)
    et = F.col("event_type")
    main = (
        F.when(et == "signup", F.when(F.col("is_boundary"), F.lit("prompt")))
        .when(et == "error", F.lit("tool_result")).otherwise(F.lit("tool_call"))
    )
    kinds = F.array_compact(F.array(
        main, F.lit("tokens"), F.when(F.col("is_edit"), F.lit("edit")), F.lit("label"), F.col("marker")))
    kind = F.col("kind")

    def only(*names: str):
        return lambda c: F.when(kind.isin(*names), c)

    tok, call, prompt, edit, label = only("tokens"), only("tool_call"), only("prompt"), only("edit"), only("label")
    code = (
        F.when(kind == "tokens", F.lit(1)).when(kind == "edit", F.lit(2)).when(kind == "label", F.lit(3))
        .when(kind.isin("prompt", "tool_call", "tool_result"), F.lit(0)).otherwise(F.lit(4))
    )
    rows = u.withColumn("kind", F.explode(kinds))
    return as_ev(rows.select(
        "platform", "file_id", (F.col("event_id") * STRIDE + code).alias("seq"), "ts", "session_id", "repo", "branch",
        "is_sidechain", "kind", ((kind == "prompt") & F.col("is_boundary")).alias("is_boundary"), "source",
        F.col("model"), *[tok(F.col(c)).alias(c) for c in
                          ("input", "cached_input", "output", "reasoning_output", "cache_creation", "total")],
        only("tool_call", "tool_result")(F.col("tool_name")).alias("tool_name"),
        call(F.col("tool_kind")).alias("tool_kind"), call(F.col("command")).alias("command"),
        call(F.col("file_base")).alias("file_base"), call(F.col("file_ext")).alias("file_ext"),
        call(F.col("is_edit")).alias("is_edit"), call(prompts.is_long_run(F.col("command"))).alias("long_run"),
        only("tool_result")(F.col("is_error")).alias("is_error"),
        F.when((kind == "tool_result") & F.col("is_error"), text.classify_error(F.col("error_text"))).alias("error_category"),
        edit(F.col("k") % 10).alias("lines_added"), edit(F.col("k") % 4).alias("lines_removed"),
        edit(F.col("k") % 5 == 0).alias("user_modified"),
        prompt(F.col("prompt_text")).alias("prompt_text"),
        prompt(prompts.is_correction(F.col("prompt_text"))).alias("is_correction"),
        prompt(prompts.is_thinking(F.col("prompt_text"))).alias("is_thinking"),
        label(F.col("label_field")).alias("label_field"), label(F.col("label")).alias("label"),
        tok(F.when(F.col("k") % 2 == 0, F.lit(200000)).otherwise(F.lit(400000))).alias("value"),
        tok(F.col("k") % 3).alias("web_search_requests"), tok(F.col("k") % 2).alias("web_fetch_requests"),
    ))
