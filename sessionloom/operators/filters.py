"""Predicates and projections on ``ev`` and on result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..functions.timez import DayWindow

SCOPES = ("global", "project", "session", "episode")


def in_window(ev: DataFrame, window: DayWindow, tz: str = "UTC") -> DataFrame:
    """Rows of the inclusive local days. A wider UTC range in front of the exact test reaches the Parquet scan."""
    low = F.lit(str(window.first)).cast("timestamp_ntz") - F.expr("INTERVAL 1 DAY")
    high = F.lit(str(window.last)).cast("timestamp_ntz") + F.expr("INTERVAL 2 DAY")
    return ev.filter((F.col("ts") >= low) & (F.col("ts") < high)).filter(window.contains(F.col("ts"), tz))


def valid_ts(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.filter(F.col(ts).isNotNull())


def main_only(ev: DataFrame) -> DataFrame:
    return ev.filter(~F.coalesce(F.col("is_sidechain"), F.lit(False)))


def for_platform(ev: DataFrame, *platforms: str) -> DataFrame:
    """Rows of the named platforms; all rows when none is named."""
    return ev.filter(F.col("platform").isin(*platforms)) if platforms else ev


def select_sessions(df: DataFrame, session_part: str | None = None, repo_part: str | None = None) -> DataFrame:
    """Substring filter on the session id and, ignoring case, on the repository."""
    if session_part:
        df = df.filter(F.contains("session_id", F.lit(session_part)))
    if repo_part:
        df = df.filter(F.contains(F.lower("repo"), F.lit(repo_part.lower())))
    return df


def nonzero_usage(df: DataFrame) -> DataFrame:
    return df.filter(F.greatest("input", "cached_input", "output", "reasoning_output") > 0)


def nonempty_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.filter((F.col("tokens") != 0) | (F.col("tool_calls") != 0) | (F.col("prompts") != 0))


def nonempty_episodes(episodes: DataFrame) -> DataFrame:
    return episodes.filter((F.col("total") > 0) | (F.col("tool_calls") > 0))


def clean_git(counts: DataFrame, command: str = "command") -> DataFrame:
    low = F.lower(command)
    return counts.filter(low.isin(text.GIT_SUBCOMMANDS)).withColumn(command, low)


def clean_commands(counts: DataFrame, command: str = "command") -> DataFrame:
    """Base names only; labels that end in a slash are dropped."""
    base = F.substring_index(F.trim(F.coalesce(F.col(command), F.lit(""))), "/", -1)
    return counts.withColumn(command, base).filter(F.col(command) != "")


def scope_key(scope: str) -> Column:
    """Grouping key of a scope; null rows belong to no bucket."""
    if scope == "project":
        repo = F.trim("repo")
        return F.when((repo != "") & (repo != "(unknown)"), repo)
    if scope == "session":
        return F.when(~F.col("is_sidechain") & (F.col("session_id") != ""), F.col("session_id"))
    if scope in SCOPES:
        return F.lit("all")
    raise ValueError(f"unknown scope {scope!r}")


def scoped(ev: DataFrame, scope: str) -> DataFrame:
    out = ev.withColumn("scope_key", scope_key(scope))
    return out.filter(F.col("scope_key").isNotNull())


def priced_models(models: DataFrame) -> DataFrame:
    return models.filter(F.col("total") > 0)
