"""Usage deltas from logs that mix per-turn and cumulative counters, and active time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.timez import epoch_micros
from .filters import main_only
from .scan import CHUNK_WIDTH, EV_WIDTH, last_before, last_seen, ordered_scan, previous, running_sum

COUNTERS = ["input", "cached_input", "output", "reasoning_output", "total"]
IDLE_CAP_SECONDS = 300


def token_deltas(df: DataFrame, width: int = CHUNK_WIDTH) -> DataFrame:
    """Per-record usage of each file.

    Rows carry ``last_*`` (per turn) and ``total_*`` (cumulative) counters; ``has_last`` and ``has_total`` say which
    are present. The state after a row is the latest cumulative value plus the per-turn values after it, so
    state = anchor + running sum, where the anchor is ``total - running sum`` at the latest cumulative row.
    """
    rows = df.filter(F.col("has_last") | F.col("has_total"))
    add = F.col("has_last") & ~F.col("has_total")
    sums = ordered_scan(rows, ["file_id"], "seq", [
        running_sum(f"_r_{c}", F.when(add, F.col(f"last_{c}")).otherwise(F.lit(0)).cast("bigint")) for c in COUNTERS], width)
    anchor = F.when(F.col("has_total"), F.struct(*[(F.col(f"total_{c}") - F.col(f"_r_{c}")).alias(c) for c in COUNTERS]))
    state = ordered_scan(sums, ["file_id"], "seq", [last_before("_a", anchor)], width)

    def raw(c: str):
        before = F.coalesce(F.col("_a")[c], F.lit(0)) + F.col(f"_r_{c}") - F.when(add, F.col(f"last_{c}")).otherwise(F.lit(0))
        return F.when(F.col("has_last"), F.col(f"last_{c}")).otherwise(F.greatest(F.lit(0), F.col(f"total_{c}") - before))

    out = state.select(*df.columns, *[raw(c).alias(f"_d_{c}") for c in COUNTERS])
    out = out.withColumns({
        "input": F.col("_d_input"), "cached_input": F.least("_d_cached_input", "_d_input"), "output": F.col("_d_output"),
        "reasoning_output": F.col("_d_reasoning_output"),
        "total": F.when(F.col("_d_total") <= 0, F.col("_d_input") + F.col("_d_output")).otherwise(F.col("_d_total")),
    })
    return out.drop(*[f"_d_{c}" for c in COUNTERS])


def active_gaps(ev: DataFrame, cap_seconds: int = IDLE_CAP_SECONDS, width: int = EV_WIDTH) -> DataFrame:
    """Main-chain usage rows with the microseconds since the previous one of the file when 0 < gap <= cap, else 0."""
    rows = main_only(ev).filter(F.col("total").isNotNull())
    seen = ordered_scan(rows, ["file_id"], "seq", [previous("_p", F.col("ts"))], width)
    gap = epoch_micros(F.col("ts")) - epoch_micros(F.col("_p"))
    ok = (gap > 0) & (gap <= cap_seconds * 1_000_000)
    return seen.withColumn("gap_micros", F.when(ok, gap).otherwise(F.lit(0).cast("bigint"))).drop("_p")


def active_seconds(ev: DataFrame, cap_seconds: int = IDLE_CAP_SECONDS, *keys: str, width: int = EV_WIDTH) -> DataFrame:
    gaps = active_gaps(ev, cap_seconds, width)
    return gaps.groupBy(*keys).agg(F.floor(F.sum("gap_micros") / 1_000_000).alias("active_seconds"))
