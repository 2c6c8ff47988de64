"""Feature adoption, hygiene and endpoint queries over snapshots that Spark derives from ``events``, ``pages`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import adoption as AD
from ..operators.scan import ordered_scan, previous
from ..functions.timez import epoch_micros
from ..session import new_path, stage
from ..sources import logs as L, signals as SG
from .adapters import events_dealt, events_wide, pick, plan_cache, table
from .registry import query, ratio4_sql, round_sql, sql_list

COUNTERS = ["memory_usage_count", "prompt_queue_use_count", "btw_use_count", "has_used_background_task"]
SNAP_SQL = """
snap AS (SELECT user_id, count(*) FILTER (WHERE k % 40 = 0) AS memory_usage_count, count(*) FILTER (WHERE k % 60 = 1) AS prompt_queue_use_count,
 CASE WHEN user_id % 5 = 0 THEN NULL ELSE count(*) FILTER (WHERE k % 9 = 2) END AS btw_use_count, max(CASE WHEN k % 80 = 3 THEN 1 ELSE 0 END) AS has_used_background_task,
 count(*) AS startups FROM u GROUP BY 1)"""
LONG_SQL = "lng AS (" + " UNION ALL ".join(f"SELECT user_id, '{c}' AS counter, {c}::DOUBLE AS value FROM snap WHERE {c} IS NOT NULL" for c in COUNTERS) + ")"


def snapshots(spark, sf):
    """One counter snapshot per user."""
    k = F.col("k")
    n = lambda c: F.count(F.when(c, F.lit(1)))
    return events_wide(spark, sf).groupBy("user_id").agg(
        n(k % 40 == 0).alias("memory_usage_count"), n(k % 60 == 1).alias("prompt_queue_use_count"),
        F.when(F.col("user_id") % 5 != 0, n(k % 9 == 2)).alias("btw_use_count"),
        F.max(F.when(k % 80 == 3, F.lit(1)).otherwise(F.lit(0))).alias("has_used_background_task"), F.count(F.lit(1)).alias("startups"))


def tips(spark, sf):
    """Tip watermarks: for each user and tip, the start-up count at its last showing."""
    tip = pick(["prompt-queue", "memory-command", "git-worktrees", "todo-list"], F.col("k"))
    per = events_wide(spark, sf).groupBy("user_id", tip.alias("tip")).agg(F.count(F.lit(1)).alias("watermark"))
    return per.join(snapshots(spark, sf).select("user_id", "startups"), "user_id")


TIPS_SQL = f"tp AS (SELECT user_id, {sql_list(['prompt-queue', 'memory-command', 'git-worktrees', 'todo-list'], 'k')} AS tip, count(*) AS watermark FROM u GROUP BY 1, 2)"


@query("s12_adoption_counters", f"WITH {SNAP_SQL}, {LONG_SQL} SELECT * FROM lng")
def _(spark, sf):
    return AD.adoption_counters(snapshots(spark, sf), ["user_id"], COUNTERS)


@query("a39_unadopted", f"""WITH {SNAP_SQL}, {LONG_SQL} SELECT user_id, CASE counter WHEN 'memory_usage_count' THEN 'memory' WHEN 'prompt_queue_use_count' THEN 'prompt-queue' ELSE 'background-tasks' END AS feature
FROM lng WHERE value = 0 AND counter <> 'btw_use_count'""")
def _(spark, sf):
    return AD.unadopted(AD.adoption_counters(snapshots(spark, sf), ["user_id"], COUNTERS))


@query("h23_tips_showing", f"WITH {SNAP_SQL}, {TIPS_SQL} SELECT user_id, tip, watermark, startups, startups - watermark <= 20 AS still_showing FROM tp JOIN snap USING (user_id) WHERE tip <> 'todo-list'")
def _(spark, sf):
    return AD.tips_showing(tips(spark, sf)).select("user_id", "tip", "watermark", "startups", "still_showing")


@query("j13_adoption_matrix", f"""WITH {SNAP_SQL}, {TIPS_SQL},
ft AS (SELECT user_id, unnest(['prompt-queue', 'memory-command', 'todo-list', 'btw-side-question']) AS feature FROM snap),
evd AS (SELECT user_id, CASE WHEN k % 60 = 1 THEN 'prompt-queue' WHEN k % 40 = 0 THEN 'memory-command' WHEN k % 9 = 2 THEN 'btw-side-question' END AS feature, count(*) AS uses FROM u GROUP BY 1, 2)
SELECT user_id, feature, coalesce(uses, 0) AS uses, CASE WHEN feature IN ('todo-list', 'btw-side-question') OR tp.watermark IS NULL THEN 'none' WHEN startups - watermark <= 30 THEN 'showing' ELSE 'frozen' END AS tip_note,
 CASE WHEN coalesce(uses, 0) > 0 THEN 'adopted' ELSE 'suggested' END AS verdict
FROM ft JOIN snap USING (user_id) LEFT JOIN evd USING (user_id, feature) LEFT JOIN tp ON tp.user_id = ft.user_id AND tp.tip = ft.feature""")
def _(spark, sf):
    k = F.col("k")
    names = F.array(*[F.lit(x) for x in ("prompt-queue", "memory-command", "todo-list", "btw-side-question")])
    features = snapshots(spark, sf).select("user_id", F.explode(names).alias("feature"))
    feature = F.when(k % 60 == 1, F.lit("prompt-queue")).when(k % 40 == 0, F.lit("memory-command")).when(k % 9 == 2, F.lit("btw-side-question"))
    evidence = events_wide(spark, sf).groupBy("user_id", feature.alias("feature")).agg(F.count(F.lit(1)).alias("uses"))
    return AD.adoption_matrix(features, evidence, tips(spark, sf), ["user_id"])


@query("a35_feature_evidence", """
SELECT session_id, count(*) FILTER (WHERE event_type = 'view' AND k % 3 = 1) AS plan_mode, count(*) FILTER (WHERE event_type = 'click') AS prompt_queue, count(*) FILTER (WHERE event_type = 'purchase') AS subagents,
 count(*) FILTER (WHERE event_type = 'error' AND k % 2 = 0 AND k % 3 = 0) AS compact_manual, count(*) FILTER (WHERE event_type = 'error' AND k % 2 = 0 AND k % 3 <> 0) AS compact_auto,
 sum(CASE WHEN event_type = 'signup' AND k % 2 = 0 THEN k % 4 ELSE 0 END)::BIGINT AS thinking_blocks, sum(CASE WHEN event_type = 'signup' AND k % 2 = 0 THEN k % 5 ELSE 0 END)::BIGINT AS todo_calls,
 count(*) FILTER (WHERE event_type = 'signup' AND k % 2 = 1 AND contains(prompt_text, 'think')) AS keyword_prompts FROM u GROUP BY 1""")
def _(spark, sf):
    et, k = F.col("event_type"), F.col("k")
    kind = (F.when(et == "view", F.lit("permission-mode")).when(et == "click", F.lit("queue-operation")).when(et == "purchase", F.lit("agent-name"))
            .when(et == "error", F.lit("system")).when(k % 2 == 0, F.lit("assistant")).otherwise(F.lit("user")))
    records = events_wide(spark, sf).select(
        "session_id", kind.alias("type"), F.when(k % 2 == 0, F.lit("compact_boundary")).otherwise(F.lit("turn_duration")).alias("subtype"),
        F.when(k % 3 == 1, F.lit("plan")).alias("mode"), F.when(k % 3 == 0, F.lit("manual")).when(k % 3 == 1, F.lit("auto")).alias("trigger"),
        (k % 4).alias("thinking_blocks"), (k % 5).alias("todo_calls"), F.coalesce(F.contains("prompt_text", F.lit("think")), F.lit(False)).alias("has_keyword"))
    return AD.feature_evidence(records, "session_id")


DUR_SQL = "d AS (SELECT epoch_us(ts) // 1000 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id)) // 1000 AS ms FROM events)"


@query("a36_hygiene_stats", f"""WITH {DUR_SQL}, s AS (SELECT ms, row_number() OVER (ORDER BY ms) - 1 AS i, count(*) OVER () AS n FROM d WHERE ms IS NOT NULL)
SELECT max(n) AS n, max(ms) FILTER (WHERE i = floor(n * 0.5::DOUBLE)::BIGINT) AS p50, max(ms) FILTER (WHERE i = floor(n * 0.95::DOUBLE)::BIGINT) AS p95, max(ms) AS max FROM s""", on_u=False)
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000").alias("ms"))
    seen = ordered_scan(e, ["user_id"], "event_id", [previous("_p", F.col("ms"))])
    turns = seen.select((F.col("ms") - F.col("_p")).alias("duration_ms")).filter(F.col("duration_ms").isNotNull())
    return AD.hygiene_stats(turns)


@query("a36_compaction_stats", f"SELECT count(*) AS n, floor(sum(total)::BIGINT::DOUBLE / count(*)::DOUBLE + 0.5::DOUBLE) AS avg, max(total) AS max FROM u WHERE marker = 'compaction'")
def _(spark, sf):
    sizes = F.when(F.col("marker") == "compaction", F.col("total"))
    return AD.compaction_stats(events_wide(spark, sf).select(sizes.alias("pre_tokens")))


@query("a37_api_error_codes", "SELECT CASE WHEN k % 3 = 0 THEN 'ECONNRESET' WHEN k % 4 = 1 THEN '529' ELSE 'unknown' END AS code, count(*) AS errors FROM u WHERE event_type = 'error' GROUP BY 1")
def _(spark, sf):
    k = F.col("k")
    rows = events_wide(spark, sf).filter(F.col("event_type") == "error").select(
        F.when(k % 3 == 0, F.lit("ECONNRESET")).when(k % 3 == 1, F.lit("")).alias("code"), F.when(k % 4 == 1, F.lit("529")).alias("status"))
    return AD.api_error_codes(rows)


@query("a38_spawn_counts", "SELECT count(*) AS spawn_edges, count(DISTINCT conv_id) AS parents FROM conversations WHERE turn > 0", on_u=False)
def _(spark, sf):
    edges = table(spark, sf, "conversations").filter(F.col("turn") > 0).select(F.col("conv_id").alias("parent"), F.col("turn").alias("child"))
    return AD.spawn_counts(edges)


@query("h21_endpoints", r"""
SELECT endpoint, count(*) AS pages FROM (SELECT CASE page_id % 3 WHEN 0 THEN 'official' ELSE 'custom' END AS endpoint FROM pages) GROUP BY 1""", on_u=False)
def _(spark, sf):
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?://[^/]+", "https://api.anthropic.com")).otherwise(F.col("url"))
    rows = AD.classify_endpoints(table(spark, sf, "pages").select(url.alias("url")))
    return rows.groupBy("endpoint").agg(F.count(F.lit(1)).alias("pages"))


@query("h22_billing_mode", """
WITH s AS (SELECT user_id, count(*) AS n, max(k) % 4 AS a, min(k) % 3 AS b, user_id % 2 = 0 AS pb, bool_or(k % 90 = 7) AS hist FROM u GROUP BY 1),
e AS (SELECT *, CASE WHEN pb THEN CASE b WHEN 0 THEN 'official' WHEN 1 THEN 'custom' ELSE 'official' END ELSE CASE b WHEN 0 THEN 'official' WHEN 1 THEN 'custom' ELSE 'official' END END AS endpoint,
 CASE WHEN pb THEN (['chatgpt', 'apikey', 'other', ''])[a + 1] ELSE (['oauth-subscription', 'api-key', 'auth-token', ''])[a + 1] END AS auth_mode FROM s)
SELECT user_id, endpoint, endpoint = 'custom' AS relay_suspected,
 CASE WHEN endpoint = 'custom' THEN 'api_or_relay' WHEN auth_mode IN ('chatgpt', 'oauth-subscription') THEN 'subscription' WHEN auth_mode IN ('apikey', 'api-key', 'auth-token') THEN 'api_or_relay' ELSE 'unknown' END AS billing_mode,
 CASE WHEN endpoint = 'custom' THEN 'high' WHEN auth_mode = 'chatgpt' THEN CASE WHEN hist THEN 'medium' ELSE 'high' END WHEN auth_mode = 'oauth-subscription' THEN 'high'
  WHEN auth_mode = 'apikey' THEN 'high' WHEN auth_mode IN ('api-key', 'auth-token') THEN 'medium' ELSE 'low' END AS confidence FROM e""")
def _(spark, sf):
    k = F.col("k")
    s = events_wide(spark, sf).groupBy("user_id").agg((F.max("k") % 4).alias("a"), (F.min("k") % 3).alias("b"), F.bool_or(k % 90 == 7).alias("history_flag"))
    b_side = F.col("user_id") % 2 == 0
    auth = F.when(b_side, pick(["chatgpt", "apikey", "other", ""], F.col("a"))).otherwise(pick(["oauth-subscription", "api-key", "auth-token", ""], F.col("a")))
    snap = s.select(
        "user_id", F.when(b_side, F.lit("B")).otherwise(F.lit("A")).alias("platform"), auth.alias("auth_mode"), "history_flag",
        F.when(b_side & (F.col("b") == 0), F.lit("openai")).when(b_side, F.lit("proxy")).alias("provider"),
        F.when(F.col("b") == 1, F.lit("https://relay.example/v1")).when(F.col("b") == 2, F.lit("https://api.openai.com/v1")).otherwise(F.lit("")).alias("base_url"))
    return AD.billing_mode(snap).select("user_id", "endpoint", "relay_suspected", "billing_mode", "confidence")


# ---- The same measures from log lines. ----
@plan_cache
def signals(spark, sf) -> DataFrame:
    """Records of further types, read from one log line per event; every 43rd line is cut off."""
    u = events_dealt(spark, sf)
    et, k = F.col("event_type"), F.col("k")
    lit = F.lit
    kind = (F.when(et == "view", F.when(k % 3 == 1, lit("permission-mode")).otherwise(lit("queue-operation"))).when(et == "click", lit("agent-name"))
            .when(et == "error", lit("system")).when(et == "purchase", lit("assistant")).otherwise(lit("user")))
    error, note = et == "error", k % 3
    code = F.when(k % 2 == 0, F.struct(F.struct(lit("ECONNRESET").alias("code")).alias("connection"), lit(None).cast("int").alias("status"))).when(
        k % 11 != 2, F.struct(lit(None).cast("struct<code: string>").alias("connection"), lit(529).alias("status")))
    block = lambda kind, name: F.struct(lit(kind).alias("type"), lit(name).cast("string").alias("name"))
    content = F.concat(F.array_repeat(block("thinking", None), (k % 3).cast("int")), F.when(k % 4 == 1, F.array(block("tool_use", "TodoWrite"))).otherwise(
        F.array().cast("array<struct<type: string, name: string>>")), F.array(block("tool_use", "Edit")))
    usage = F.struct(F.struct(k.alias("ephemeral_5m_input_tokens"), F.expr("k div 3").alias("ephemeral_1h_input_tokens")).alias("cache_creation"))
    says = F.concat("prompt_text", F.when(k % 2 == 0, lit(" UltraThink")).otherwise(lit("")))
    head = [kind.alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.col("session_id").alias("sessionId")]
    size = F.when(k % 5 != 0, F.struct(F.when(k % 2 == 0, lit("manual")).otherwise(lit("auto")).alias("trigger"), F.col("input").alias("preTokens")))
    line = F.to_json(F.struct(
        *head, F.when(et == "view", F.when(k % 2 == 0, lit("plan")).otherwise(lit("default"))).alias("permissionMode"),
        F.when(et == "view", F.when(k % 2 == 0, lit("enqueue")).otherwise(lit("dequeue"))).alias("operation"),
        F.when(et == "click", F.concat(lit("agent"), k % 3)).alias("agentName"),
        F.when(error, F.when(note == 0, lit("compact_boundary")).when(note == 1, lit("turn_duration")).otherwise(lit("api_error"))).alias("subtype"),
        F.when(error, size).alias("compactMetadata"), F.when(error & (k % 7 != 0), F.col("total")).alias("durationMs"), F.when(error, code).alias("error"),
        F.when(et == "purchase", F.struct(content.alias("content"), usage.alias("usage"))).alias("message")))
    said = F.to_json(F.struct(*head, F.struct(says.alias("content")).alias("message")))
    value = F.when(et == "signup", said).otherwise(line)
    lines = u.select("file_id", F.col("event_id").alias("line_no"), F.when(k % 43 == 7, F.substring(value, 1, 25)).otherwise(value).alias("value"))
    good, _ = L.parse_json(stage(lines, "lines-signals"))
    return SG.land_signals(SG.signal_records(good), new_path(spark, "signals"))


WHOLE = "s AS (SELECT * FROM u WHERE k % 43 <> 7)"


@query("a35_feature_evidence_lines", f"""WITH {WHOLE}
SELECT session_id, count(*) FILTER (WHERE event_type = 'view' AND k % 3 = 1 AND k % 2 = 0) AS plan_mode, count(*) FILTER (WHERE event_type = 'view' AND k % 3 <> 1) AS prompt_queue,
 count(*) FILTER (WHERE event_type = 'click') AS subagents, count(*) FILTER (WHERE event_type = 'error' AND k % 3 = 0 AND k % 5 <> 0 AND k % 2 = 0) AS compact_manual,
 count(*) FILTER (WHERE event_type = 'error' AND k % 3 = 0 AND (k % 5 = 0 OR k % 2 = 1)) AS compact_auto,
 sum(CASE WHEN event_type = 'purchase' THEN k % 3 ELSE 0 END)::BIGINT AS thinking_blocks, count(*) FILTER (WHERE event_type = 'purchase' AND k % 4 = 1) AS todo_calls,
 count(*) FILTER (WHERE event_type = 'signup' AND k % 2 = 0) AS keyword_prompts FROM s GROUP BY 1""")
def _(spark, sf):
    return AD.feature_evidence(signals(spark, sf), "session_id")


@query("a36_turn_lines", f"""WITH {WHOLE}, d AS (SELECT total AS ms, row_number() OVER (ORDER BY total) - 1 AS i, count(*) OVER () AS n FROM s WHERE event_type = 'error' AND k % 3 = 1 AND k % 7 <> 0)
SELECT max(n) AS n, max(ms) FILTER (WHERE i = floor(n * 0.5::DOUBLE)::BIGINT) AS p50, max(ms) FILTER (WHERE i = floor(n * 0.95::DOUBLE)::BIGINT) AS p95, max(ms) AS max FROM d""")
def _(spark, sf):
    return AD.hygiene_stats(AD.turns_of(signals(spark, sf)))


@query("a36_compaction_lines", f"""WITH {WHOLE}
SELECT count(*) AS n, floor(sum(input)::BIGINT::DOUBLE / count(*)::DOUBLE + 0.5::DOUBLE) AS avg, max(input) AS max FROM s WHERE event_type = 'error' AND k % 3 = 0 AND k % 5 <> 0""")
def _(spark, sf):
    return AD.compaction_stats(signals(spark, sf))


@query("a37_error_code_lines", f"""WITH {WHOLE}
SELECT CASE WHEN k % 2 = 0 THEN 'ECONNRESET' WHEN k % 11 <> 2 THEN '529' ELSE 'unknown' END AS code, count(*) AS errors FROM s WHERE event_type = 'error' AND k % 3 = 2 GROUP BY 1""")
def _(spark, sf):
    return AD.api_error_codes(AD.api_errors_of(signals(spark, sf)))


@query("p6_cache_ttl", f"""WITH {WHOLE}
SELECT session_id, count(*) AS records, sum(k)::BIGINT AS written_5m, sum(k // 3)::BIGINT AS written_1h, {ratio4_sql('sum(k)', 'sum(k) + sum(k // 3)')} AS share_5m
FROM s WHERE event_type = 'purchase' GROUP BY 1""")
def _(spark, sf):
    return AD.cache_ttl_split(signals(spark, sf), "session_id")


@query("p6_signal_labels", f"""WITH {WHOLE}
SELECT CASE WHEN event_type = 'click' THEN 'agent-name' WHEN k % 3 = 1 THEN 'permission-mode' ELSE 'queue-operation' END AS type,
 CASE WHEN event_type = 'click' THEN 'agent' || (k % 3) WHEN k % 3 = 1 THEN CASE WHEN k % 2 = 0 THEN 'plan' ELSE 'default' END WHEN k % 2 = 0 THEN 'enqueue' ELSE 'dequeue' END AS label,
 count(*) AS records FROM s WHERE event_type IN ('view', 'click') GROUP BY 1, 2""")
def _(spark, sf):
    return AD.signal_labels(signals(spark, sf))
