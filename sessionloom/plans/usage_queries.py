"""Filters, sets, ranked cuts, usage and cost queries over ``events`` seen as session records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import models as M, numbers as N, text as X, timez as Z
from ..operators import filters as FI, joins as J, topk as K, usage as U
from .adapters import events_as_ev, events_wide, table
from .registry import NORM, query, ratio4_sql, ratio_sql, round_sql

DAY = "strftime({0}, '%Y-%m-%d')"
COST = "sum(nano)::DOUBLE / 1e9::DOUBLE AS cost_usd"
BUCKETS = ("sum(input)::BIGINT AS input, sum(cached_input)::BIGINT AS cached_input, sum(output)::BIGINT AS output, "
           "sum(reasoning_output)::BIGINT AS reasoning_output, sum(cache_creation)::BIGINT AS cache_creation, sum(total)::BIGINT AS total")
NAMED = "CASE WHEN NOT is_sidechain THEN session_id END"
LAST_DAY = dt.date(2024, 1, 30)


@query("f1_resolve_window", f"SELECT {DAY.format('ts')} AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-24' AND DATE '2024-01-30' GROUP BY 1", on_u=False)
def _(spark, sf):
    w = Z.resolve_window(days=7, today=LAST_DAY)
    rows = FI.in_window(table(spark, sf, "events"), w)
    return rows.groupBy(Z.day_text(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("f2_in_window_zone", f"""
SELECT {DAY.format("ts + INTERVAL '5 hours 45 minutes'")} AS day, count(*) AS n FROM events
WHERE CAST(ts + INTERVAL '5 hours 45 minutes' AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-11' GROUP BY 1""", on_u=False)
def _(spark, sf):
    w = Z.DayWindow(dt.date(2024, 1, 5), dt.date(2024, 1, 11))
    rows = FI.in_window(table(spark, sf, "events"), w, "Asia/Kathmandu")
    return rows.groupBy(Z.day_text(F.col("ts"), "Asia/Kathmandu").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("f3_valid_ts", """
SELECT count(*) AS kept FROM (SELECT try_cast(CASE WHEN event_id % 9 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS TIMESTAMP) AS t FROM events) WHERE t IS NOT NULL""", on_u=False)
def _(spark, sf):
    e = table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 9 == 0, F.lit("bad")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return FI.valid_ts(e.select(Z.parse_instant(raw).alias("ts"))).agg(F.count(F.lit(1)).alias("kept"))


@query("f5_main_only", "SELECT session_id, count(*) AS n, sum(total)::BIGINT AS tokens FROM u WHERE NOT is_sidechain GROUP BY 1")
def _(spark, sf):
    rows = FI.main_only(events_as_ev(spark, sf)).filter(F.col("kind") == "tokens")
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("tokens"))


@query("f7_for_platform", f"SELECT platform, count(*) AS n, {BUCKETS} FROM u WHERE platform = 'B' GROUP BY 1")
def _(spark, sf):
    rows = FI.for_platform(events_as_ev(spark, sf), "B").filter(F.col("kind") == "tokens")
    return rows.groupBy("platform").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in U.TOKEN_BUCKETS])


@query("f8_select_sessions", "SELECT session_id, repo, count(*) AS n FROM u WHERE contains(session_id, '1') AND contains(lower(repo), 'repo1') GROUP BY 1, 2")
def _(spark, sf):
    rows = FI.select_sessions(events_as_ev(spark, sf).filter(F.col("kind") == "tokens"), "1", "REPO1")
    return rows.groupBy("session_id", "repo").agg(F.count(F.lit(1)).alias("n"))


@query("f10_nonzero_usage", "SELECT model, count(*) AS n FROM u WHERE greatest(input, cached_input, output, reasoning_output) > 0 GROUP BY 1")
def _(spark, sf):
    return FI.nonzero_usage(events_as_ev(spark, sf)).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("f11_nonempty_sessions", """
SELECT file_id, sum(CASE WHEN k % 2 = 0 THEN total ELSE 0 END)::BIGINT AS tokens, count(*) FILTER (WHERE is_call AND k % 5 = 0) AS tool_calls,
 count(*) FILTER (WHERE is_boundary AND k % 7 = 0) AS prompts FROM u GROUP BY 1
HAVING tokens <> 0 OR tool_calls <> 0 OR prompts <> 0""")
def _(spark, sf):
    u = events_wide(spark, sf)
    k = F.col("k")
    per = u.groupBy("file_id").agg(
        F.sum(F.when(k % 2 == 0, F.col("total")).otherwise(F.lit(0))).alias("tokens"),
        N.count_true(F.col("tool_kind").isNotNull() & (k % 5 == 0)).alias("tool_calls"),
        N.count_true(F.col("is_boundary") & (k % 7 == 0)).alias("prompts"))
    return FI.nonempty_sessions(per)


@query("f13_or_unknown", "SELECT CASE WHEN source = '' THEN '(unknown)' ELSE source END AS name, count(*) AS n FROM u GROUP BY 1")
def _(spark, sf):
    return events_wide(spark, sf).groupBy(N.or_unknown(F.col("source")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("f14_clean_labels", r"""
SELECT label, kind, count(*) AS n FROM (
 SELECT 'command' AS kind, list_extract(string_split(string_split(command, ' ')[1], '/'), -1) AS label FROM u WHERE command IS NOT NULL
 UNION ALL
 SELECT 'git' AS kind, lower(string_split(command, ' ')[2]) AS label FROM u WHERE command IS NOT NULL
  AND lower(string_split(command, ' ')[2]) IN ('status', 'push', 'diff', 'commit')) WHERE label <> '' GROUP BY 1, 2""")
def _(spark, sf):
    u = events_wide(spark, sf).filter(F.col("command").isNotNull())
    part = lambda i: F.coalesce(F.get(F.split("command", " "), F.lit(i)), F.lit(""))
    first = FI.clean_commands(u.select(part(0).alias("command"))).withColumn("kind", F.lit("command"))
    second = FI.clean_git(u.select(part(1).alias("command"))).withColumn("kind", F.lit("git"))
    return first.unionByName(second).groupBy(F.col("command").alias("label"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query("f16_scoped", """
SELECT 'project' AS scope, repo AS scope_key, count(*) AS n, sum(total)::BIGINT AS tokens FROM u GROUP BY 1, 2
UNION ALL SELECT 'session', session_id, count(*), sum(total)::BIGINT FROM u WHERE NOT is_sidechain GROUP BY 1, 2
UNION ALL SELECT 'global', 'all', count(*), sum(total)::BIGINT FROM u""")
def _(spark, sf):
    ev = events_as_ev(spark, sf).filter(F.col("kind") == "tokens")
    out = None
    for scope in ("project", "session", "global"):
        part = FI.scoped(ev, scope).groupBy(F.lit(scope).alias("scope"), "scope_key").agg(
            F.count(F.lit(1)).alias("n"), F.sum("total").alias("tokens"))
        out = part if out is None else out.unionByName(part)
    return out


@query("f17_priced_models", "SELECT model, total FROM (SELECT model_norm AS model, sum(CASE WHEN model_norm = 'mystery' THEN 0 ELSE total END)::BIGINT AS total FROM u GROUP BY 1) WHERE total > 0")
def _(spark, sf):
    per = U.model_tokens(events_as_ev(spark, sf), n=None).select("model", "total")
    zeroed = per.withColumn("total", F.when(F.col("model") == "mystery", F.lit(0)).otherwise(F.col("total")))
    return FI.priced_models(zeroed)


@query("u1_union_platforms", f"SELECT platform, count(*) AS n, {BUCKETS} FROM u GROUP BY 1")
def _(spark, sf):
    from ..operators.compare import union_platforms
    ev = events_as_ev(spark, sf)
    both = union_platforms(FI.for_platform(ev, "A"), FI.for_platform(ev, "B").drop("cache_creation"))
    rows = both.filter(F.col("kind") == "tokens").withColumn("cache_creation", F.coalesce("cache_creation", F.lit(0)))
    return rows.groupBy("platform").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in U.TOKEN_BUCKETS])


@query("u2_active_days", f"SELECT DISTINCT {DAY.format('ts')} AS day FROM u")
def _(spark, sf):
    return U.model_days(events_as_ev(spark, sf)).select("day").distinct()


@query("u3_branch_contexts", "SELECT DISTINCT repo || '@' || branch AS context FROM u")
def _(spark, sf):
    return U.repo_branches(events_as_ev(spark, sf)).select(F.concat("repo", F.lit("@"), "branch").alias("context"))


@query("u4_unpriced_set", "SELECT DISTINCT model_norm AS model FROM u EXCEPT SELECT model_norm FROM model_price")
def _(spark, sf):
    days = U.model_days(events_as_ev(spark, sf))
    # one pass; a filter on the price alone would move below the sums and look up a price for every record
    return days.groupBy("model").agg(F.max("priced").alias("priced")).filter(~F.col("priced")).select("model")


@query("t1_top_counts", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 12", on_u=False)
def _(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return K.top_counts(counts, 12, "n", "l_suppkey")


@query("t1_top_per_group", """
SELECT l_returnflag, l_suppkey, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_suppkey) AS rank
 FROM (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE rank <= 5""", on_u=False)
def _(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return K.top_per_group(counts, 5, ["l_returnflag"], "n", "l_suppkey")


REPO_SQL = f"""SELECT repo, sum(total)::BIGINT AS tokens, {COST}, count(DISTINCT {NAMED}) AS sessions, count(DISTINCT branch) AS branches FROM u GROUP BY 1"""


@query("t2_top_repos", f"{REPO_SQL} ORDER BY tokens DESC, repo LIMIT 5")
def _(spark, sf):
    return K.top_repos(U.by_repo(events_as_ev(spark, sf)), 5)


@query("t3_top_sources", """
WITH s AS (SELECT session_id, arg_min(source, file_id || lpad(CAST(event_id AS VARCHAR), 12, '0')) FILTER (WHERE source <> '') AS source FROM u GROUP BY 1),
t AS (SELECT session_id, sum(total)::BIGINT AS tokens FROM u WHERE NOT is_sidechain GROUP BY 1)
SELECT source AS name, sum(tokens)::BIGINT AS tokens, count(*) AS sessions FROM t JOIN s USING (session_id) WHERE source IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2""")
def _(spark, sf):
    return K.top_counts(U.by_source(events_as_ev(spark, sf)), 2, "tokens", "name")


@query("t4_model_day_series", f"""
WITH d AS (SELECT model_norm AS model, {DAY.format('ts')} AS day, sum(total)::BIGINT AS tokens FROM u GROUP BY 1, 2),
best AS (SELECT model FROM d GROUP BY 1 ORDER BY sum(tokens) DESC, model LIMIT 3)
SELECT model, day, tokens FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY day DESC) AS r FROM d WHERE model IN (SELECT model FROM best)) WHERE r <= 10""")
def _(spark, sf):
    return U.model_day_series(events_as_ev(spark, sf), models=3, days=10)


@query("a1_token_totals", f"SELECT {BUCKETS} FROM u")
def _(spark, sf):
    return U.token_totals(events_as_ev(spark, sf))


@query("a2_estimate_cost", f"SELECT platform, sum(total)::BIGINT AS tokens, {COST}, sum(CASE WHEN priced THEN total ELSE 0 END)::BIGINT AS priced_tokens FROM u GROUP BY 1")
def _(spark, sf):
    return U.estimate_cost(events_as_ev(spark, sf), "platform")


@query("a3_cache_rates", f"SELECT platform, {ratio_sql('sum(cached_input)', 'sum(cached_input) + sum(fresh)')} AS cache_hit_rate, {ratio_sql('sum(reasoning_output)', 'sum(output)')} AS reasoning_ratio FROM u GROUP BY 1")
def _(spark, sf):
    return U.cache_rates(events_as_ev(spark, sf), "platform")


DOMINANT_SQL = """SELECT repo, language FROM (SELECT repo, language, row_number() OVER (PARTITION BY repo ORDER BY n DESC, file_ext) AS r FROM (
 SELECT repo, file_ext, CASE file_ext WHEN 'py' THEN 'Python' WHEN 'ts' THEN 'TypeScript' WHEN 'sql' THEN 'SQL' END AS language, count(*) AS n
 FROM u WHERE file_ext IS NOT NULL AND NOT is_sidechain GROUP BY 1, 2, 3) WHERE language IS NOT NULL) WHERE r = 1"""


@query("a4_by_repo", f"WITH r AS ({REPO_SQL}), d AS ({DOMINANT_SQL}) SELECT r.*, d.language FROM r LEFT JOIN d USING (repo)")
def _(spark, sf):
    from ..operators.behavior import dominant_language
    ev = events_as_ev(spark, sf)
    return U.by_repo(ev, dominant_language(ev))


@query("a5_by_hour", "SELECT hour(ts + INTERVAL '5 hours 45 minutes') AS hour, sum(total)::BIGINT AS tokens, count(*) AS events FROM u GROUP BY 1 HAVING sum(total) > 0")
def _(spark, sf):
    return U.by_hour(events_as_ev(spark, sf), "Asia/Kathmandu")


@query("a6_by_source", """
WITH s AS (SELECT session_id, source FROM (SELECT session_id, source, row_number() OVER (PARTITION BY session_id ORDER BY file_id, event_id) AS r FROM u WHERE source <> '') WHERE r = 1),
t AS (SELECT session_id, sum(total)::BIGINT AS tokens FROM u WHERE NOT is_sidechain GROUP BY 1)
SELECT source AS name, sum(tokens)::BIGINT AS tokens, count(*) AS sessions FROM t JOIN s USING (session_id) GROUP BY 1""")
def _(spark, sf):
    return U.by_source(events_as_ev(spark, sf))


@query("a7_models_timeline", f"""
SELECT model_norm AS model, {DAY.format('min(ts)')} AS first_day, {DAY.format('max(ts)')} AS last_day, sum(total)::BIGINT AS tokens, {COST},
 count(DISTINCT CAST(ts AS DATE)) AS active_days FROM u GROUP BY 1 ORDER BY tokens DESC, model LIMIT 10""")
def _(spark, sf):
    return U.models_timeline(events_as_ev(spark, sf))


@query("a7_orders_by_month", """
SELECT o_orderstatus AS model, strftime(o_orderdate, '%Y-%m') AS month, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents, count(*) AS n FROM orders GROUP BY 1, 2""", on_u=False)
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return o.groupBy(F.col("o_orderstatus").alias("model"), "month").agg(F.sum(cents).alias("cents"), F.count(F.lit(1)).alias("n"))


@query("a8_model_tokens", f"SELECT model_norm AS model, {BUCKETS}, {COST}, bool_or(priced) AS priced FROM u GROUP BY 1 ORDER BY total DESC, model LIMIT 10")
def _(spark, sf):
    return U.model_tokens(events_as_ev(spark, sf))


@query("a20_billing", """
WITH p AS (SELECT file_id, plan FROM (SELECT file_id, plan, row_number() OVER (PARTITION BY file_id ORDER BY event_id) AS r FROM u WHERE plan IS NOT NULL) WHERE r = 1),
t AS (SELECT file_id, sum(total)::BIGINT AS tokens FROM u GROUP BY 1)
SELECT coalesce(plan, '(unclassified)') AS plan, sum(tokens)::BIGINT AS tokens, count(*) AS files FROM t LEFT JOIN p USING (file_id) WHERE tokens > 0 GROUP BY 1""")
def _(spark, sf):
    plans = J.file_plan(events_wide(spark, sf).withColumn("seq", F.col("event_id")))
    return U.billing(events_as_ev(spark, sf), plans)


@query("a23_server_tools", "SELECT sum(k % 3)::BIGINT AS web_search_requests, sum(k % 2)::BIGINT AS web_fetch_requests FROM u WHERE NOT is_sidechain")
def _(spark, sf):
    return U.server_tools(events_as_ev(spark, sf))


@query("a27_activity", f"SELECT platform, count(DISTINCT {NAMED}) AS sessions, count(DISTINCT CAST(ts AS DATE)) AS active_days FROM u GROUP BY 1")
def _(spark, sf):
    return U.activity(events_as_ev(spark, sf), "platform")


@query("a31_by_language", f"""
SELECT CASE WHEN k % 3 = 0 THEN 'Python' WHEN k % 3 = 1 THEN 'Go' ELSE '(unknown)' END AS name, sum(total)::BIGINT AS tokens, count(DISTINCT {NAMED}) AS sessions FROM u GROUP BY 1""")
def _(spark, sf):
    u = events_wide(spark, sf)
    lang = F.when(F.col("k") % 3 == 0, F.lit("Python")).when(F.col("k") % 3 == 1, F.lit("Go")).otherwise(F.lit(""))
    return U.by_language(u, lang)


@query("a32_daily_series", f"SELECT {DAY.format('ts')} AS day, sum(total)::BIGINT AS tokens FROM u GROUP BY 1")
def _(spark, sf):
    return U.daily_series(events_as_ev(spark, sf))


@query("a32_date_range", f"SELECT {DAY.format('min(ts)')} AS first_day, {DAY.format('max(ts)')} AS last_day FROM u")
def _(spark, sf):
    return U.date_range(events_as_ev(spark, sf))


@query("a33_combined_totals", f"""
SELECT platform, sum(total)::BIGINT AS tokens, {COST}, count(*) AS records FROM u GROUP BY 1
UNION ALL SELECT 'all', sum(total)::BIGINT, {COST}, count(*) FROM u""")
def _(spark, sf):
    return U.combined_totals(events_as_ev(spark, sf))


PARTS = ("sum(fresh)::BIGINT AS fresh, sum(CASE WHEN claude THEN cached_input ELSE least(cached_input, input) END)::BIGINT AS cache_read, "
         "sum(CASE WHEN claude THEN cache_creation ELSE 0 END)::BIGINT AS cache_write, sum(output)::BIGINT AS output, "
         "sum(reasoning_output)::BIGINT AS reasoning, sum(total)::BIGINT AS total")


@query("a40_token_composition", f"""
WITH p AS (SELECT platform, {PARTS} FROM u GROUP BY 1)
SELECT *, fresh + cache_read + cache_write AS input_side, {', '.join(f'{ratio4_sql(c, "total")} AS {c}_share' for c in ('fresh', 'cache_read', 'cache_write', 'output'))} FROM p""")
def _(spark, sf):
    return U.token_composition(events_as_ev(spark, sf), "platform")


@query("a44_model_class_share", f"""
SELECT platform, {ratio_sql("sum(CASE WHEN contains(model_norm, 'opus') THEN nano ELSE 0 END)", 'sum(nano)')} AS cost_share,
 count(DISTINCT CASE WHEN priced THEN model_norm END) AS priced_models FROM u GROUP BY 1""")
def _(spark, sf):
    return U.model_class_cost_share(events_as_ev(spark, sf), "opus", "platform")


@query("j6_lookup_price", "SELECT DISTINCT model, p_in, p_cached, p_out FROM u1 LEFT JOIN model_price USING (model_norm)")
def _(spark, sf):
    from ..sources.prices import price_table
    found = J.lookup_price(events_wide(spark, sf), price_table(spark))
    p = F.col("price")
    return found.select("model", p["input"].alias("p_in"), p["cached_input"].alias("p_cached"), p["output"].alias("p_out"))


@query("j8_unpriced_models", "SELECT DISTINCT model_norm AS model FROM u WHERE NOT priced")
def _(spark, sf):
    return U.unpriced_models(events_as_ev(spark, sf))


# One name matches exactly, one only in another case, the rest fall back.
OFFICIAL = [("claude-opus-4-8", 5.0, 0.5, 25.0, 6.25), ("GPT-5.1-Codex", 1.3, 0.13, 10.4, None), ("unused", 1.0, 1.0, 1.0, None)]


def official_prices(spark):
    return spark.createDataFrame(OFFICIAL, "name string, input double, cached_input double, output double, cache_creation double")


OFFICIAL_SQL = f"""
 m AS (SELECT platform, model_norm AS model, {BUCKETS}, {COST} FROM u GROUP BY 1, 2),
 q AS (SELECT *, CASE model WHEN 'claude-opus-4-8' THEN (input * 5.0::DECIMAL(12,6) + cached_input * 0.5::DECIMAL(12,6) + cache_creation * 6.25::DECIMAL(12,6) + output * 25.0::DECIMAL(12,6))::DOUBLE / 1e6::DOUBLE
   WHEN 'gpt-5.1-codex' THEN ((input - least(cached_input, input)) * 1.3::DECIMAL(12,6) + least(cached_input, input) * 0.13::DECIMAL(12,6) + output * 10.4::DECIMAL(12,6))::DOUBLE / 1e6::DOUBLE END AS online FROM m),
 c AS (SELECT platform, model, online IS NOT NULL AS official, {round_sql('coalesce(online, cost_usd)')} AS cost FROM q WHERE total > 0)"""


@query("j7_official_prices", f"WITH {OFFICIAL_SQL} SELECT * FROM c")
def _(spark, sf):
    models = U.model_tokens(events_as_ev(spark, sf), "platform", n=None)
    return J.apply_official_prices(models, official_prices(spark)).select("platform", "model", "official", "cost")


@query("a34_platform_cost", f"""WITH {OFFICIAL_SQL}
SELECT platform, {round_sql("sum(CAST(round(cost * 10000) AS BIGINT))::DOUBLE / 10000.0::DOUBLE", 2)} AS cost_usd, bool_and(official) AS all_priced,
 count(*) FILTER (WHERE NOT official) AS unpriced_models FROM c GROUP BY 1""")
def _(spark, sf):
    models = U.model_tokens(events_as_ev(spark, sf), "platform", n=None)
    return J.platform_cost(J.apply_official_prices(models, official_prices(spark)))


@query("j12_combined_by_model", f"""
SELECT coalesce(platform, 'all') AS platform, coalesce(model_norm, 'all') AS model, sum(total)::BIGINT AS tokens FROM u GROUP BY ROLLUP (platform, model_norm)""")
def _(spark, sf):
    rows = U.usage_rows(events_as_ev(spark, sf)).groupBy("platform", "model_norm").agg(F.sum("total").alias("t"))
    return rows.rollup("platform", "model_norm").agg(F.sum("t").alias("tokens")).select(
        F.coalesce("platform", F.lit("all")).alias("platform"), F.coalesce("model_norm", F.lit("all")).alias("model"), "tokens")
