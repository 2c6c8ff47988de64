"""Feature adoption, hygiene statistics, endpoints and billing mode over snapshot tables of many hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import count_true, ratio, round_to
from ..functions.text import host_class, url_host
from .scan import CHUNK_WIDTH, quantiles

# Counters whose zero means "not adopted", conditional tips and their cool-down in start-ups.
ADOPTION_RULES = {
    "memory_usage_count": "memory", "prompt_queue_use_count": "prompt-queue", "has_used_background_task": "background-tasks",
    "automations": "automations", "spawn_edges": "multi-agent", "prefix_rules": "smart-approvals", "user_skills": "skills",
    "memory_files": "memories", "ambient_suggestions": "ambient-suggestions",
}
CONDITIONAL_TIPS = ["prompt-queue", "memory-command", "git-worktrees", "custom-agents", "plan-mode-for-complex-tasks"]
TIP_COOLDOWN = 20
PROBE_COOLDOWN = 30


def adoption_counters(snapshots: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Listed counter columns in long form; missing values leave no row."""
    pairs = F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).cast("double").alias("value")) for c in counters])
    return snapshots.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.counter", "_p.value").filter(F.col("value").isNotNull())


def unadopted(counters: DataFrame) -> DataFrame:
    """Features whose counter is exactly zero."""
    name = F.create_map(*[F.lit(x) for pair in ADOPTION_RULES.items() for x in pair])
    rows = counters.filter(F.col("counter").isin(list(ADOPTION_RULES)) & (F.col("value") == 0))
    return rows.withColumn("feature", F.element_at(name, F.col("counter"))).drop("counter", "value")


def tips_showing(tips: DataFrame) -> DataFrame:
    """Conditional tips with whether they were still shown within the cool-down; needs startups, tip, watermark."""
    return tips.filter(F.col("tip").isin(CONDITIONAL_TIPS)).withColumn(
        "still_showing", F.coalesce(F.col("startups") - F.col("watermark") <= TIP_COOLDOWN, F.lit(False)))


def adoption_matrix(features: DataFrame, evidence: DataFrame, tips: DataFrame, keys: list[str]) -> DataFrame:
    """Feature x own evidence x tip note; evidence has keys, feature, uses; tips has keys, tip, startups, watermark."""
    t = tips.select(*keys, F.col("tip").alias("feature"), (F.col("startups") - F.col("watermark")).alias("_age"))
    e = evidence.groupBy(*keys, "feature").agg(F.sum("uses").alias("uses"))
    joined = features.join(e, [*keys, "feature"], "left").join(t, [*keys, "feature"], "left")
    conditional = F.col("feature").isin(CONDITIONAL_TIPS) & F.col("_age").isNotNull()
    note = F.when(~conditional, F.lit("none")).when(F.col("_age") <= PROBE_COOLDOWN, F.lit("showing")).otherwise(F.lit("frozen"))
    uses = F.coalesce(F.col("uses"), F.lit(0))
    return joined.select(*keys, "feature", uses.alias("uses"), note.alias("tip_note"),
                         F.when(uses > 0, F.lit("adopted")).otherwise(F.lit("suggested")).alias("verdict"))


def feature_evidence(records: DataFrame, *keys: str) -> DataFrame:
    """Counts of usage evidence by record type; records carry type, subtype, mode, trigger, tool and text flags."""
    c = F.col
    system = c("type") == "system"
    compact = system & (c("subtype") == "compact_boundary")
    return records.groupBy(*keys).agg(
        count_true((c("type") == "permission-mode") & (c("mode") == "plan")).alias("plan_mode"),
        count_true(c("type") == "queue-operation").alias("prompt_queue"),
        count_true(c("type") == "agent-name").alias("subagents"),
        count_true(compact & (c("trigger") == "manual")).alias("compact_manual"),
        count_true(compact & (F.coalesce(c("trigger"), F.lit("")) != "manual")).alias("compact_auto"),
        F.sum(F.when(c("type") == "assistant", c("thinking_blocks")).otherwise(F.lit(0))).alias("thinking_blocks"),
        F.sum(F.when(c("type") == "assistant", c("todo_calls")).otherwise(F.lit(0))).alias("todo_calls"),
        count_true((c("type") == "user") & c("has_keyword")).alias("keyword_prompts"))


def hygiene_stats(turns: DataFrame, duration: str = "duration_ms", width: int = CHUNK_WIDTH) -> DataFrame:
    """Count, p50, p95 (the values at sorted index floor(n*q)) and maximum of turn durations; one row, with nulls when there is none."""
    picks = {"p50": ("index", 0.5), "p95": ("index", 0.95), "max": ("nearest", 1.0)}
    found = quantiles(turns, [], duration, picks, width)
    return found.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("n"), *[F.max(c).alias(c) for c in picks])


def cache_ttl_split(signals: DataFrame, *keys: str) -> DataFrame:
    """P6: cache writes by how long they live, and the share that lives five minutes only."""
    rows = signals.filter((F.col("type") == "assistant") & (F.col("cache_5m").isNotNull() | F.col("cache_1h").isNotNull()))
    short, long = (F.coalesce(F.sum(c), F.lit(0)) for c in ("cache_5m", "cache_1h"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"), short.alias("written_5m"), long.alias("written_1h"), round_to(ratio(short, short + long), 4).alias("share_5m"))


def signal_labels(signals: DataFrame, *keys: str) -> DataFrame:
    """P6: how often each mode was set, each queue operation made and each agent named."""
    label = F.coalesce("mode", "operation", "agent", F.lit("(unknown)"))
    rows = signals.filter(F.col("type").isin("permission-mode", "queue-operation", "agent-name"))
    return rows.groupBy(*keys, "type", label.alias("label")).agg(F.count(F.lit(1)).alias("records"))


def api_errors_of(signals: DataFrame) -> DataFrame:
    return signals.filter((F.col("type") == "system") & (F.col("subtype") == "api_error"))


def turns_of(signals: DataFrame) -> DataFrame:
    return signals.filter((F.col("type") == "system") & (F.col("subtype") == "turn_duration"))


def compaction_stats(df: DataFrame, size: str = "pre_tokens") -> DataFrame:
    rows = df.filter(F.col(size).isNotNull())
    return rows.agg(F.count(F.lit(1)).alias("n"), round_to(ratio(F.sum(size), F.count(F.lit(1))), 0).alias("avg"), F.max(size).alias("max"))


def api_error_codes(errors: DataFrame) -> DataFrame:
    """Errors per code; the connection code goes first, then the status, then ``unknown``."""
    code = F.coalesce(F.nullif(F.col("code"), F.lit("")), F.nullif(F.col("status"), F.lit("")), F.lit("unknown"))
    return errors.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("errors"))


def spawn_counts(edges: DataFrame, parent: str = "parent", *keys: str) -> DataFrame:
    return edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("spawn_edges"), F.count_distinct(parent).alias("parents"))


def classify_endpoints(df: DataFrame, url: str = "url") -> DataFrame:
    """Host class of a URL column; custom hosts are not named."""
    host = url_host(F.col(url))
    kind = host_class(host)
    return df.withColumn("endpoint", kind).withColumn("official_host", F.when(kind == "official", host))


def _endpoint(url: Column, default: Column) -> Column:
    kind = host_class(url_host(url))
    return F.when(F.coalesce(url, F.lit("")) == "", default).when(kind == "official", F.lit("official")).otherwise(F.lit("custom"))


def billing_mode(snapshots: DataFrame) -> DataFrame:
    """Endpoint, billing mode and confidence of each host snapshot.

    Platform B without a custom provider uses the official host; a custom provider without a readable host counts
    as custom. Needs platform, base_url, provider, auth_mode, history_flag.
    """
    c = F.col
    b = c("platform") == "B"
    own = b & (F.coalesce(c("provider"), F.lit("openai")).isin("", "openai"))
    endpoint = F.when(own, F.lit("official")).otherwise(_endpoint(c("base_url"), F.when(b, F.lit("custom")).otherwise(F.lit("official"))))
    rows = snapshots.withColumn("endpoint", endpoint)
    custom, auth = c("endpoint") == "custom", c("auth_mode")
    subscription = F.when(b, auth == "chatgpt").otherwise(auth == "oauth-subscription")
    keyed = F.when(b, auth == "apikey").otherwise(auth.isin("api-key", "auth-token"))
    mode = (F.when(custom, F.lit("api_or_relay")).when(subscription, F.lit("subscription"))
            .when(keyed, F.lit("api_or_relay")).otherwise(F.lit("unknown")))
    flagged = F.coalesce(c("history_flag"), F.lit(False))
    confidence = (
        F.when(custom, F.lit("high"))
        .when(subscription, F.when(b & flagged, F.lit("medium")).otherwise(F.lit("high")))
        .when(keyed, F.when(b, F.lit("high")).otherwise(F.lit("medium"))).otherwise(F.lit("low")))
    return rows.withColumns({"relay_suspected": custom, "billing_mode": mode, "confidence": confidence})
