"""Token and cost measures of usage records (rows of ``ev`` with a total)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import models as M
from ..functions.numbers import count_true, or_unknown, ratio, round_to
from ..functions.timez import day_text, local_hour
from ..schema import TOKEN_BUCKETS
from . import topk
from .filters import main_only


def weight(ev: DataFrame):
    """Records that a row stands for: one, or ``records`` of compact rows."""
    return F.col("records") if "records" in ev.columns else F.lit(1)


def usage_rows(ev: DataFrame) -> DataFrame:
    """Usage records with the normalized model and the part of the input not read from a cache; compact rows have all that."""
    if "uncached" in ev.columns:
        return ev.filter(F.col("total").isNotNull())
    model = M.normalize_model(F.col("model"))
    return ev.filter(F.col("total").isNotNull()).withColumns({
        "model_norm": model,
        "uncached": M.uncached_input(F.col("input"), F.col("cached_input")),
        "fresh": M.fresh_input(F.col("model"), F.col("input"), F.col("cached_input")),
    })


def _sums() -> list:
    return [F.sum(c).alias(c) for c in (*TOKEN_BUCKETS, "uncached", "fresh")]


def priced_sums(usage: DataFrame, *keys: str) -> DataFrame:
    """Bucket sums and exact cost per (keys, model): tokens are summed first, prices touch only the groups."""
    sums = usage.groupBy(*keys, "model_norm").agg(*_sums(), F.sum(weight(usage)).alias("records"))
    price = M.price_of(F.col("model_norm"))
    nano = M.cost_nano(price, *[F.col(c) for c in ("input", "cached_input", "cache_creation", "output", "uncached")])
    return sums.select("*", nano.alias("nano"), price.isNotNull().alias("priced"))


def token_totals(ev: DataFrame, *keys: str) -> DataFrame:
    rows = ev.filter(F.col("total").isNotNull())
    return rows.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOKEN_BUCKETS])


def estimate_cost(ev: DataFrame, *keys: str) -> DataFrame:
    return priced_sums(usage_rows(ev), *keys).groupBy(*keys).agg(
        F.sum("total").alias("tokens"),
        M.nano_to_usd(F.sum("nano")).alias("cost_usd"),
        F.sum(F.when(F.col("priced"), F.col("total")).otherwise(F.lit(0))).alias("priced_tokens"),
    )


def cache_rates(ev: DataFrame, *keys: str) -> DataFrame:
    return usage_rows(ev).groupBy(*keys).agg(
        ratio(F.sum("cached_input"), F.sum("cached_input") + F.sum("fresh")).alias("cache_hit_rate"),
        ratio(F.sum("reasoning_output"), F.sum("output")).alias("reasoning_ratio"),
    )


def _named_session(col: str = "session_id"):
    """Session id of main-chain rows; sub-agent rows carry none."""
    return F.when(~F.col("is_sidechain") & (F.col(col) != ""), F.col(col))


def by_repo(ev: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """Tokens, cost, sessions and branches per repository; ``languages`` adds the main language."""
    usage = usage_rows(ev).withColumn("repo", or_unknown(F.col("repo")))
    sums = priced_sums(usage, "repo").groupBy("repo").agg(
        F.sum("total").alias("tokens"), M.nano_to_usd(F.sum("nano")).alias("cost_usd"))
    sets = usage.groupBy("repo").agg(
        F.count_distinct(_named_session()).alias("sessions"),
        F.count_distinct(F.when(F.col("branch") != "", F.col("branch"))).alias("branches"))
    out = sums.join(sets, "repo")
    return out.join(languages, "repo", "left") if languages is not None else out


def repo_branches(ev: DataFrame) -> DataFrame:
    """Distinct (repo, branch) pairs of usage records."""
    rows = ev.filter(F.col("total").isNotNull() & (F.col("branch") != ""))
    return rows.select(or_unknown(F.col("repo")).alias("repo"), "branch").distinct()


def by_hour(ev: DataFrame, tz: str = "UTC") -> DataFrame:
    rows = ev.filter(F.col("total").isNotNull()).groupBy(local_hour(F.col("ts"), tz).alias("hour"))
    return rows.agg(F.sum("total").alias("tokens"), F.sum(weight(ev)).alias("events")).filter(F.col("tokens") > 0)


def session_source(ev: DataFrame) -> DataFrame:
    """First non-empty entry point of each session in (file, line) order."""
    named = ev.filter((F.col("session_id") != "") & (F.trim("source") != ""))
    return named.groupBy("session_id").agg(F.min_by(F.trim("source"), F.struct("file_id", "seq")).alias("source"))


def by_source(ev: DataFrame) -> DataFrame:
    """Tokens and sessions per source. Tokens are summed per session first, so a hot session joins as one row."""
    tokens = main_only(ev).filter(F.col("total").isNotNull()).groupBy("session_id").agg(F.sum("total").alias("tokens"))
    joined = tokens.join(session_source(ev), "session_id")
    return joined.groupBy(or_unknown(F.col("source")).alias("name")).agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("sessions"))


def model_days(ev: DataFrame, tz: str = "UTC") -> DataFrame:
    """Bucket sums and cost per (model, day); rows without a model are left out."""
    usage = usage_rows(ev).filter(F.col("model_norm") != "")
    return priced_sums(usage.withColumn("day", day_text(F.col("ts"), tz)), "day").withColumnRenamed("model_norm", "model")


def models_timeline(ev: DataFrame, tz: str = "UTC", n: int = topk.MODELS_MAX) -> DataFrame:
    totals = model_days(ev, tz).groupBy("model").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("total").alias("tokens"),
        M.nano_to_usd(F.sum("nano")).alias("cost_usd"), F.count(F.lit(1)).alias("active_days"))
    return topk.top_counts(totals, n, "tokens", "model")


def model_day_series(ev: DataFrame, tz: str = "UTC", models: int = topk.MODELS_MAX, days: int = topk.DAYS_MAX) -> DataFrame:
    """Daily tokens of the top models, latest days only."""
    per_day = model_days(ev, tz).select("model", "day", F.col("total").alias("tokens"))
    best = models_timeline(ev, tz, models).select("model")
    return topk.last_days(per_day.join(F.broadcast(best), "model", "left_semi"), days, ["model"])


def model_tokens(ev: DataFrame, *keys: str, n: int | None = topk.MODELS_MAX) -> DataFrame:
    usage = usage_rows(ev).filter(F.col("model_norm") != "")
    sums = priced_sums(usage, *keys).select(
        *keys, F.col("model_norm").alias("model"), *TOKEN_BUCKETS, M.nano_to_usd(F.col("nano")).alias("cost_usd"), "priced")
    return sums if n is None else topk.top_counts(sums, n, "total", "model")


def unpriced_models(ev: DataFrame) -> DataFrame:
    """Models seen without a known price."""
    seen = usage_rows(ev).select(F.col("model_norm").alias("model")).distinct().filter(F.col("model") != "")
    return seen.filter(M.price_of(F.col("model")).isNull())


def billing(ev: DataFrame, file_plan: DataFrame) -> DataFrame:
    """Tokens and files per plan label; files without a label fall under ``(unclassified)``."""
    per_file = ev.filter(F.col("total").isNotNull()).groupBy("file_id").agg(F.sum("total").alias("tokens"))
    joined = per_file.filter(F.col("tokens") > 0).join(file_plan, "file_id", "left")
    return joined.groupBy(F.coalesce("plan", F.lit("(unclassified)")).alias("plan")).agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("files"))


def server_tools(ev: DataFrame) -> DataFrame:
    rows = main_only(ev)
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("web_search_requests", "web_fetch_requests")])


def activity(ev: DataFrame, *keys: str, tz: str = "UTC") -> DataFrame:
    """Distinct main-chain sessions and distinct days with a model."""
    day = F.when(F.col("total").isNotNull() & (M.normalize_model(F.col("model")) != ""), day_text(F.col("ts"), tz))
    touches = (F.col("kind") == "tokens") | (
        (F.col("platform") == "A") & F.col("kind").isin("prompt", "tool_result", "touch"))
    touched = F.when(touches, _named_session())
    pre = ev.select(*keys, day.alias("day"), touched.alias("session"))
    return pre.groupBy(*keys).agg(
        F.count_distinct("session").alias("sessions"), F.count_distinct("day").alias("active_days"))


def by_language(ev: DataFrame, language) -> DataFrame:
    """Tokens and sessions per value of a language expression."""
    rows = ev.filter(F.col("total").isNotNull()).withColumn("name", or_unknown(language))
    return rows.groupBy("name").agg(F.sum("total").alias("tokens"), F.count_distinct(_named_session()).alias("sessions"))


def daily_series(ev: DataFrame, tz: str = "UTC") -> DataFrame:
    return model_days(ev, tz).groupBy("day").agg(F.sum("total").alias("tokens"))


def date_range(ev: DataFrame, tz: str = "UTC", *keys: str) -> DataFrame:
    usage = usage_rows(ev).filter(F.col("model_norm") != "")
    day = day_text(F.col("ts"), tz)
    return usage.groupBy(*keys).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def combined_totals(ev: DataFrame) -> DataFrame:
    """Per-platform totals plus one ``all`` row, from one scan."""
    sums = priced_sums(usage_rows(ev), "platform")
    rolled = sums.rollup("platform").agg(
        F.sum("total").alias("tokens"), M.nano_to_usd(F.sum("nano")).alias("cost_usd"), F.sum("records").alias("records"))
    return rolled.withColumn("platform", F.coalesce("platform", F.lit("all")))


def token_composition(ev: DataFrame, *keys: str) -> DataFrame:
    """Disjoint parts (fresh, read, write, output) with shares, and the input-side total."""
    u = usage_rows(ev)
    disjoint = M.is_disjoint(F.col("model"))
    read = F.when(disjoint, F.col("cached_input")).otherwise(F.least("cached_input", "input"))
    write = F.when(disjoint, F.col("cache_creation")).otherwise(F.lit(0))
    parts = u.groupBy(*keys).agg(
        F.sum("fresh").alias("fresh"), F.sum(read).alias("cache_read"), F.sum(write).alias("cache_write"),
        F.sum("output").alias("output"), F.sum("reasoning_output").alias("reasoning"), F.sum("total").alias("total"))
    return parts.select(
        "*", (F.col("fresh") + F.col("cache_read") + F.col("cache_write")).alias("input_side"),
        *[round_to(ratio(F.col(c), F.col("total")), 4).alias(f"{c}_share") for c in ("fresh", "cache_read", "cache_write", "output")])


def model_class_cost_share(ev: DataFrame, name_part: str = "opus", *keys: str) -> DataFrame:
    sums = priced_sums(usage_rows(ev), *keys)
    part = F.sum(F.when(F.contains("model_norm", F.lit(name_part)), F.col("nano")).otherwise(F.lit(0).cast("decimal(36,0)")))
    return sums.groupBy(*keys).agg(ratio(part, F.sum("nano")).alias("cost_share"), count_true(F.col("priced")).alias("priced_models"))
