"""Ranked cuts. Every order ends in a key, so ties are stable; cuts come last, after all statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

REPOS_MAX, USAGE_MAX, MODELS_MAX, DAYS_MAX, EPISODES_MAX = 50, 15, 10, 31, 200


def top_counts(df: DataFrame, n: int, count: str, *keys: str) -> DataFrame:
    """The n rows with the largest count, ties by key."""
    return df.orderBy(F.desc(count), *[F.asc(k) for k in keys]).limit(n)


def top_per_group(df: DataFrame, n: int, group: list[str], count: str, *keys: str) -> DataFrame:
    """The n largest rows of each group. Spark prunes each map task to n rows per group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(F.desc(count), *[F.asc(k) for k in keys])
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def last_days(series: DataFrame, n: int, group: list[str], day: str = "day") -> DataFrame:
    """The n latest days of each group."""
    w = Window.partitionBy(*group).orderBy(F.desc(day))
    return series.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def top_repos(repos: DataFrame, n: int = REPOS_MAX) -> DataFrame:
    return top_counts(repos, n, "tokens", "repo")


def top_sessions(sessions: DataFrame, n: int = 20) -> DataFrame:
    """Most tokens, then most tool calls; n <= 0 keeps all."""
    ranked = sessions.orderBy(F.desc("tokens"), F.desc("tool_calls"), "session_id")
    return ranked.limit(n) if n > 0 else ranked


def top_episodes(episodes: DataFrame, n: int = EPISODES_MAX) -> DataFrame:
    return episodes.orderBy(F.desc("severity"), F.desc("total"), "file_id", "ep").limit(n)
