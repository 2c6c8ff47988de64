"""Redacted, size-budgeted content digests and prompt previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.prompts import prompt_flags
from ..functions.numbers import round_to
from ..functions.redact import redact
from ..functions.timez import epoch_micros
from ..functions.text import collapse_ws, strip_ws
from .joins import session_prompts
from .scan import CHUNK_WIDTH, ordered_scan, running_sum

# Characters per item and in total.
BUDGETS = {"tight": (200, 30_000), "rich": (600, 120_000)}


def tool_input_summary(name: Column, field) -> Column:
    """Short text of a tool input; ``field(key)`` gives a string column, ``field(None)`` the whole input as JSON."""
    def s(*keys: str) -> Column:
        return F.coalesce(*[field(k) for k in keys], F.lit(""))

    return (
        F.when(name == "Bash", F.concat(F.lit("cmd: "), s("command")))
        .when(name.isin("Edit", "NotebookEdit"), F.concat(
            F.lit("file "), s("file_path", "notebook_path"), F.lit(" | -"), F.substring(s("old_string"), 1, 140),
            F.lit(" +"), F.substring(s("new_string"), 1, 140)))
        .when(name == "Write", F.concat(F.lit("file "), s("file_path"), F.lit(" | "), F.substring(s("content"), 1, 160)))
        .when(name == "Read", F.concat(F.lit("file "), s("file_path")))
        .when(name == "Grep", F.concat(F.lit("q "), s("pattern"), F.lit(" @ "), s("path", "glob")))
        .otherwise(F.substring(F.coalesce(field(None), F.lit("")), 1, 220))
    )


def number_items(items: DataFrame, width: int = CHUNK_WIDTH) -> DataFrame:
    """Number the items of each session by (time, file, line, block); items without a time come first.

    Items are counted per millisecond first; the running count over milliseconds gives each one its offset, and
    only items of the same millisecond are ranked against each other.
    """
    ms = F.coalesce(F.floor(epoch_micros(F.col("ts")) / 1000), F.lit(0)).cast("bigint")
    rows = items.withColumn("_ms", ms)
    counts = rows.groupBy("session_id", "_ms").agg(F.count(F.lit(1)).alias("_n"))
    offsets = ordered_scan(counts, ["session_id"], "_ms", [running_sum("_upto", F.col("_n"))], width).select(
        F.col("session_id").alias("_s"), F.col("_ms").alias("_m"), (F.col("_upto") - F.col("_n")).alias("_offset"))
    tie = Window.partitionBy("session_id", "_ms").orderBy("file_id", "seq", "block_no")
    ranked = rows.withColumn("_r", F.row_number().over(tie))
    joined = ranked.join(offsets, (F.col("session_id") == F.col("_s")) & (F.col("_ms") == F.col("_m")))
    return joined.select("session_id", (F.col("_offset") + F.col("_r") - 1).alias("pos"), "kind", "text")


def pack_items(items: DataFrame, keys: list[str], order: str, per_item: int = 200, max_total: int = 30_000,
               width: int = CHUNK_WIDTH, home: str | None = None) -> DataFrame:
    """Redact each item and mark it as emitted while the characters emitted before it stay below the total.

    The running total only grows, so adding all earlier items instead of only the emitted ones gives the same cut.
    """
    short = items.select(
        *keys, order, "kind", F.length("text").cast("bigint").alias("raw_chars"),
        redact(collapse_ws(F.col("text")), per_item, home).alias("preview"))
    sized = short.withColumn("chars", F.length("preview").cast("bigint"))
    seen = ordered_scan(sized, keys, order, [running_sum("_upto", F.col("chars"))], width)
    return seen.withColumn("emitted", F.col("_upto") - F.col("chars") < max_total).drop("_upto")


def digest_items(packed: DataFrame) -> DataFrame:
    return packed.filter("emitted").drop("emitted", "raw_chars", "chars")


def digest_stats(packed: DataFrame, keys: list[str]) -> DataFrame:
    out = F.coalesce(F.sum(F.when(F.col("emitted"), F.col("chars"))), F.lit(0))
    return packed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"), F.count(F.when(F.col("emitted"), F.lit(1))).alias("emitted_items"),
        F.count(F.when(~F.col("emitted"), F.lit(1))).alias("dropped"), F.sum("raw_chars").alias("raw_chars"),
        out.alias("emitted_chars"), F.floor(out / 4 + 0.5).cast("bigint").alias("est_tokens"))


def prompt_preview(prompts: DataFrame, keys: list[str], order: str, text: str, limit: int = 1200, width: int = CHUNK_WIDTH) -> DataFrame:
    """Time-ordered prompts of the given sessions with flags and a redacted preview, numbered from 0."""
    clean = prompts.withColumn("_t", strip_ws(F.col(text))).filter(F.col("_t") != "")
    numbered = ordered_scan(clean, keys, order, [running_sum("_n", F.lit(1).cast("bigint"))], width)
    return numbered.select(
        *keys, order, (F.col("_n") - 1).alias("idx"), *[c.alias(n) for n, c in prompt_flags(F.col("_t")).items()],
        redact(F.col("_t"), limit).alias("preview"))


def selected_session_preview(ev: DataFrame, selected: DataFrame, limit: int = 1200) -> DataFrame:
    """Preview of one selected session's prompts, ordered by (ts, file, position)."""
    rows = session_prompts(ev, selected).withColumn("_t", strip_ws(F.col("prompt_text")))
    # One selected session is the feature here; only its prompts reach this window.
    w = Window.partitionBy("session_id").orderBy(F.asc_nulls_first("ts"), "file_id", "seq")
    return rows.select(
        "session_id", (F.row_number().over(w) - 1).alias("idx"), "ts", *[c.alias(n) for n, c in prompt_flags(F.col("_t")).items()],
        redact(F.col("_t"), limit).alias("preview"))
