"""Both platforms side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.models import nano_to_usd
from ..functions.numbers import count_true, or_unknown, percent_share
from ..functions.text import GIT_SUBCOMMANDS
from ..functions.timez import local_hour
from ..session import stage
from . import episodes as E, usage as U
from .filters import main_only


def union_platforms(*evs: DataFrame) -> DataFrame:
    """One event set; columns missing on one side become nulls."""
    out = evs[0]
    for ev in evs[1:]:
        out = out.unionByName(ev, allowMissingColumns=True)
    return out


#: Rows that a block of the profile shows; the others show all of theirs.
BLOCK_LIMITS = {"command": 12, "git": 10, "tool_name": 15, "language": 10, "repo": 10, "permission_mode": 4, "skill": 12}
ALL_ROWS = 1000


def profile_counts(ev: DataFrame, tz: str = "UTC") -> DataFrame:
    """Sums by (platform, block, name, session, file) of every block at once: one scan, each row opened into what it counts for.

    Only the blocks that need a session's first record carry session, file and the smallest position; buffers are numbers.
    """
    c, kind = F.col, F.col("kind")
    main = ~F.coalesce(c("is_sidechain"), F.lit(False))
    call, used = main & (kind == "tool_call"), c("total").isNotNull()
    shell, file = call & (c("tool_kind") == "shell"), call & (c("tool_kind") == "file")
    label = F.when(kind == "label", c("label_field"))
    low_git = F.lower(T.git_subcommand(c("command")))

    def of(block: str, when: Column, name: Column, n: Column | None = None, *, session: Column | None = None, file_id: Column | None = None) -> Column:
        text = F.when(when, name.cast("string"))
        return F.when(F.coalesce(text, F.lit("")) != "", F.struct(
            F.lit(block).alias("block"), text.alias("name"), (F.lit(1) if n is None else n).cast("bigint").alias("n"),
            (F.lit(None) if session is None else session).cast("string").alias("session"),
            (F.lit(None) if file_id is None else file_id).cast("string").alias("file")))

    facets = F.array_compact(F.array(
        of("tool_kind", call, c("tool_kind")), of("tool_name", call, c("tool_name")), of("mcp", call, T.mcp_server(c("tool_name"))),
        of("command", shell & (c("command") != ""), F.substring_index(F.trim(T.first_token(c("command"))), "/", -1)),
        of("git", shell & F.contains("command", F.lit("git")) & low_git.isin(GIT_SUBCOMMANDS), low_git),
        of("language", file & (c("file_ext") != ""), F.coalesce(T.language_of(c("file_ext")), F.upper("file_ext"))),
        of("skill", label == "skill", T.skill_short(c("label"))), of("permission_mode", label == "permission_mode", c("label")),
        of("subagent", kind == "subagent", F.lit("messages")), of("hour", used, local_hour(c("ts"), tz)),
        of("repo", used, or_unknown(c("repo")), c("total")),
        of("session", main & used & (c("session_id") != ""), F.lit("used"), session=c("session_id")),
        of("entry", c("session_id") != "", F.trim("source"), session=c("session_id"), file_id=c("file_id"))))
    rows = ev.select("platform", "seq", F.explode(facets).alias("_f")).select("platform", "seq", "_f.*")
    return rows.groupBy("platform", "block", "name", "session", "file").agg(F.sum("n").alias("n"), F.min("seq").alias("first_seq"))


def platform_profile(ev: DataFrame, tz: str = "UTC") -> DataFrame:
    """What each platform was used for as (platform, block, name, n): tools, servers, skills, commands, kinds, version control, languages,
    repositories by tokens, hours, sources by sessions, and permission modes with sub-agent messages."""
    counts = stage(profile_counts(ev, tz), "profile")
    plain = counts.filter(~F.col("block").isin("session", "entry")).select("platform", "block", "name", "n")
    sources = counts.filter(F.col("block") == "entry").groupBy("platform", "session").agg(F.min_by("name", F.struct("file", "first_seq")).alias("name"))
    used = counts.filter(F.col("block") == "session").select("platform", "session")
    by_source = sources.join(used, ["platform", "session"]).groupBy("platform", F.lit("source").alias("block"), "name").agg(F.count(F.lit(1)).alias("n"))
    limits = F.create_map(*[F.lit(x) for pair in BLOCK_LIMITS.items() for x in pair])
    place = F.row_number().over(Window.partitionBy("platform", "block").orderBy(F.desc("n"), "name"))
    ranked = plain.unionByName(by_source).withColumn("_place", place).filter(F.col("_place") <= ALL_ROWS)  # pruned to that many on the map side
    return ranked.filter(F.col("_place") <= F.coalesce(limits[F.col("block")], F.lit(ALL_ROWS))).drop("_place")


def platform_summary(ev: DataFrame, tz: str = "UTC", episodes: DataFrame | None = None) -> DataFrame:
    """One row per platform: sessions, days, range, disjoint tokens, cost, cache rate; ``episodes`` adds their summary."""
    cost = U.priced_sums(U.usage_rows(ev), "platform").groupBy("platform").agg(nano_to_usd(F.sum("nano")).alias("cost_usd"))
    parts = (
        U.activity(ev, "platform"), U.date_range(ev, tz, "platform"),
        U.token_composition(ev, "platform").select("platform", "fresh", "cache_read", "cache_write", "output", "total"),
        U.cache_rates(ev, "platform").select("platform", "cache_hit_rate"))
    out = cost
    for part in parts:
        out = out.join(part, "platform")
    return out if episodes is None else out.join(E.episode_summary(episodes, "platform"), "platform", "left")


def platform_top_sessions(ev: DataFrame, n: int = 10) -> DataFrame:
    """The sessions of each platform with the most main-chain tokens: tokens, calls, span, and the repository with most of the tokens."""
    rows = main_only(ev).filter(F.coalesce("session_id", F.lit("")) != "")
    per = rows.groupBy("platform", "session_id", or_unknown(F.col("repo")).alias("repo")).agg(
        F.sum("total").alias("tokens"), count_true(F.col("kind") == "tool_call").alias("tool_calls"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    top_repo = F.min(F.struct((-F.coalesce("tokens", F.lit(0))).alias("t"), "repo"))["repo"]
    whole = per.groupBy("platform", "session_id").agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.sum("tool_calls").alias("tool_calls"), F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"), top_repo.alias("repo")).filter(F.col("tokens") > 0)
    place = F.row_number().over(Window.partitionBy("platform").orderBy(F.desc("tokens"), F.desc("tool_calls"), "session_id"))
    return whole.withColumn("place", place).filter(F.col("place") <= n)


METRICS = ("sessions", "active_days", "fresh", "cache_read", "output", "total", "cost_usd")


def compare_platforms(summary: DataFrame) -> DataFrame:
    """metric, a, b and A's share of the sum in percent."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])
    long = summary.select("platform", F.explode(pairs).alias("_p")).select("platform", "_p.metric", "_p.value")
    wide = long.groupBy("metric").pivot("platform", ["A", "B"]).agg(F.sum("value"))
    a, b = F.coalesce("A", F.lit(0.0)), F.coalesce("B", F.lit(0.0))
    return wide.select("metric", a.alias("a"), b.alias("b"), percent_share(a, a + b).alias("a_share"))
