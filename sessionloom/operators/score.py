"""Four tier scores per user from aggregate numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import ratio


def prompt_tier() -> Column:
    """0 (best) to 4; 2 without data."""
    c = F.col
    q = (F.lit(0.30) * c("structured_ratio") + F.lit(0.25) * c("constraint_ratio") + F.lit(0.20) * c("file_ref_ratio")
         + F.lit(0.25) * (F.lit(1.0) - c("correction_rate")))
    q = q - F.when((c("avg_len") > 1500) | (c("avg_len") < 12), F.lit(0.12)).otherwise(F.lit(0.0))
    tier = F.when(q >= 0.62, 0).when(q >= 0.45, 1).when(q >= 0.30, 2).when(q >= 0.16, 3).otherwise(4)
    return F.when(c("prompts") == 0, F.lit(2)).otherwise(tier)


def spending_tier() -> Column:
    c = F.col
    per_session = c("tokens").cast("double") / F.greatest(c("sessions"), F.lit(1)).cast("double")
    return (F.when((c("premium_share") >= 0.6) & (per_session < 8000), F.lit(3))
            .when(c("cost_usd") >= 30, F.lit(2)).when(c("cost_usd") >= 5, F.lit(1)).otherwise(F.lit(0)))


def engineering_tier() -> Column:
    c = F.col
    loop = (c("shell_calls") + c("web_calls") + c("search_calls")).cast("double") / (c("file_calls") + 1).cast("double")
    per_session = c("repos").cast("double") / F.greatest(c("sessions"), F.lit(1)).cast("double")
    return (F.when((per_session >= 2.0) | ((c("repos") >= 4) & (c("sessions") <= 2)), F.lit(3))
            .when(loop >= 4, F.lit(2)).when(loop >= 1.5, F.lit(1)).otherwise(F.lit(0)))


def diligence_tier() -> Column:
    c = F.col
    late = ratio(c("late_events"), c("hour_events"))
    return (F.when((c("active_days") <= 1) & (c("sessions") <= 2), F.lit(3)).when(late >= 0.35, F.lit(1))
            .when(c("active_days") >= 5, F.lit(0)).otherwise(F.lit(2)))


def autonomy_tier(hands_off_below: float = 0.5) -> Column:
    """P10: 3 with hardly any edits per session, else 0 to 2 by how often a person changed the edits."""
    c = F.col
    per_session = c("edits").cast("double") / F.greatest(c("sessions"), F.lit(1)).cast("double")
    return (F.when(per_session < hands_off_below, F.lit(3)).when(c("user_modified_rate") >= 0.5, F.lit(0))
            .when(c("user_modified_rate") >= 0.15, F.lit(1)).otherwise(F.lit(2)))


def tier_scores(users: DataFrame, *keys: str) -> DataFrame:
    return users.select(
        *keys, prompt_tier().alias("prompt_tier"), spending_tier().alias("spending_tier"),
        engineering_tier().alias("engineering_tier"), diligence_tier().alias("diligence_tier"))
