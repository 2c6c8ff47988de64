"""Queries of the proposed measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import logs as L
from ..schema import STRIDE
from ..operators import behavior as B, episodes as E, proposals as P, score
from ..operators.usage import usage_rows
from .adapters import events_as_ev, events_wide, pick
from .episode_queries import CAP, EPS, _detail
from .registry import ERROR_SQL, LONG_RUN_SQL, query, ratio4_sql, ratio_sql, round_sql, sql_list

LINES = ["bash: foo: command not found", "write failed: ENOSPC", "JavaScript heap out of memory", "process killed", "SyntaxError: bad", "2 tests failed", "fetch failed", "odd", "TypeError: x is undefined"]


@query("p1_error_origin", f"""
WITH c AS (SELECT CASE WHEN regexp_matches(t, 'command not found|not recognized as|executable file not found', 'i') THEN 'command-not-found' WHEN regexp_matches(t, 'ENOSPC|no space left', 'i') THEN 'disk'
 WHEN regexp_matches(t, 'ENOMEM|out of memory', 'i') THEN 'oom' WHEN regexp_matches(t, 'SIGKILL|SIGTERM|killed|core dumped|aborted', 'i') THEN 'signal'
 WHEN regexp_matches(t, 'SyntaxError|unexpected token|parse error', 'i') THEN 'syntax'
  WHEN {ERROR_SQL.format('t')} = 'other' AND regexp_matches(t, 'TypeError', 'i') THEN 'type' ELSE {ERROR_SQL.format('t')} END AS category FROM (SELECT {sql_list(LINES, 'k')} AS t FROM u WHERE is_result))
SELECT category, CASE WHEN category IN ('network', 'timeout', 'permission', 'disk', 'oom', 'command-not-found', 'signal') THEN 'external' WHEN category = 'other' THEN 'neither' ELSE 'internal' END AS origin, count(*) AS errors
FROM c GROUP BY 1, 2""")
def _(spark, sf):
    rows = events_wide(spark, sf).filter(F.col("event_type") == "error")
    category = P.classify_error_fine(pick(LINES, F.col("k")))
    return rows.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("errors")).withColumn("origin", P.error_origin(F.col("category")))


@query("p2_own_baselines", EPS + "SELECT task_type, quantile_disc(duration_seconds, 0.5) AS p50, quantile_disc(duration_seconds, 0.9) AS p90, count(*) AS episodes FROM ep GROUP BY 1")
def _(spark, sf):
    return P.own_baselines(_detail(spark, sf))


@query("p2_weekly_change", EPS + f""", w AS (SELECT strftime(date_trunc('week', start_ts), '%Y-%m-%d') AS week, count(*) AS episodes, {ratio4_sql('count(*) FILTER (WHERE severity > 0)', 'count(*)')} AS spiral_rate FROM ep GROUP BY 1)
SELECT *, lag(spiral_rate) OVER (ORDER BY week) AS previous_rate FROM w""")
def _(spark, sf):
    return P.weekly_change(_detail(spark, sf))


@query("p2_baselines_cold_start", EPS + """, b AS (SELECT task_type, start_ts < TIMESTAMP '2024-01-08' AS old, quantile_disc(duration_seconds, 0.5) AS p50, quantile_disc(duration_seconds, 0.9) AS p90, count(*) AS episodes FROM ep GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY CASE WHEN old AND episodes >= 5 THEN 0 WHEN NOT old THEN 1 ELSE 2 END) AS r FROM b)
SELECT task_type, p50, p90, episodes, CASE WHEN old THEN 'history' ELSE 'window' END AS basis, episodes < 5 AS low_confidence FROM r WHERE r = 1""")
def _(spark, sf):
    return P.baselines(_detail(spark, sf), F.lit("2024-01-08").cast("timestamp_ntz"))


NANO_SUM = "sum(round(cost_usd * 1e9::DOUBLE)::HUGEINT)::DOUBLE / 1e9::DOUBLE"


@query("p3_findings", EPS + f"""SELECT finding, count(*) AS episodes, sum(total)::BIGINT AS tokens, {NANO_SUM} AS cost_usd,
 CASE finding WHEN 'edit_ring' THEN 'plan-mode' WHEN 'error_dense' THEN 'hooks' WHEN 'no_progress' THEN 'sub-agents' ELSE 'checkpoints' END AS feature_fix FROM (
 SELECT 'edit_ring' AS finding, total, cost_usd FROM ep WHERE edit_ring UNION ALL SELECT 'error_dense', total, cost_usd FROM ep WHERE error_dense
 UNION ALL SELECT 'no_progress', total, cost_usd FROM ep WHERE no_progress UNION ALL SELECT 'time_outlier', total, cost_usd FROM ep WHERE time_outlier) GROUP BY 1""")
def _(spark, sf):
    return P.findings(_detail(spark, sf))


@query("p4_style_drift", f"""
WITH m AS (SELECT session_id, {ratio4_sql('count(*) FILTER (WHERE is_error AND ts >= TIMESTAMP $$2024-01-16$$)', 'count(*) FILTER (WHERE is_result AND ts >= TIMESTAMP $$2024-01-16$$)')} AS now,
 {ratio4_sql('count(*) FILTER (WHERE is_error AND ts < TIMESTAMP $$2024-01-16$$)', 'count(*) FILTER (WHERE is_result AND ts < TIMESTAMP $$2024-01-16$$)')} AS old FROM u WHERE NOT is_sidechain GROUP BY 1
 HAVING min(ts) < TIMESTAMP $$2024-01-16$$ AND max(ts) >= TIMESTAMP $$2024-01-16$$)
SELECT session_id, 'error_rate' AS metric, now AS value, old AS profile_value, now - old AS change FROM m WHERE abs(now - old) > 0.02::DOUBLE""".replace("$$", "'"))
def _(spark, sf):
    ev = events_as_ev(spark, sf)
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    rate = lambda rows: B.error_signals(rows, "session_id").select("session_id", F.lit("error_rate").alias("metric"), F.col("error_rate").alias("value"))
    return P.style_drift(rate(ev.filter(F.col("ts") >= cut)), rate(ev.filter(F.col("ts") < cut)), ["session_id"], 0.02)


@query("p8_interruption_windows", EPS + """, sp AS (SELECT file_id, ep, file_base, min(event_id) AS a, max(event_id) AS b FROM e WHERE is_edit GROUP BY 1, 2, 3)
SELECT i.file_id, i.ep, i.event_id, (SELECT count(*) FROM e c WHERE c.file_id = i.file_id AND c.ep = i.ep AND c.is_call AND c.event_id < i.event_id) AS calls_before,
 (SELECT arg_max(tool_kind, event_id) FROM e c WHERE c.file_id = i.file_id AND c.ep = i.ep AND c.is_call AND c.event_id < i.event_id) AS tool_kind_before,
 EXISTS (SELECT 1 FROM sp WHERE sp.file_id = i.file_id AND sp.ep = i.ep AND sp.a < i.event_id AND sp.b > i.event_id) AS redo_same_file
FROM e i WHERE i.marker = 'interrupt'""")
def _(spark, sf):
    rows = P.interruption_windows(E.label_episodes(events_as_ev(spark, sf), CAP))
    return rows.select("file_id", "ep", F.expr(f"seq div {STRIDE}").alias("event_id"), "calls_before", "tool_kind_before", "redo_same_file")


@query("p9_primary_platform", """
SELECT session_id, sum(n)::BIGINT AS records, CASE WHEN max(n)::DOUBLE / sum(n)::DOUBLE >= 0.8::DOUBLE THEN arg_max(platform, n) END AS primary_platform
FROM (SELECT session_id, platform, count(*) AS n FROM u GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    return P.primary_platform(usage_rows(events_as_ev(spark, sf)), "session_id")


TASK_COST_SQL = f"c AS (SELECT task_type, platform, count(*) AS episodes, sum(total)::BIGINT AS tokens, {NANO_SUM} AS cost_usd, {round_sql(f'{NANO_SUM} / count(*)::DOUBLE', 6)} AS cost_per_episode FROM ep GROUP BY 1, 2)"


@query("p9_task_cost_by_platform", EPS + f", {TASK_COST_SQL} SELECT * FROM c")
def _(spark, sf):
    return P.task_cost_by_platform(_detail(spark, sf))


@query("p9_task_routes", EPS + f""", {TASK_COST_SQL}, a AS (SELECT * FROM c WHERE platform = 'A'), b AS (SELECT * FROM c WHERE platform = 'B')
SELECT task_type, a.episodes AS a_episodes, a.cost_per_episode AS a_cost_per_episode, b.episodes AS b_episodes, b.cost_per_episode AS b_cost_per_episode,
 CASE WHEN a.episodes >= 5 AND b.episodes >= 5 THEN CASE WHEN a.cost_per_episode < b.cost_per_episode THEN 'A' WHEN a.cost_per_episode > b.cost_per_episode THEN 'B' END END AS route
FROM a FULL JOIN b USING (task_type)""")
def _(spark, sf):
    return P.task_routes(_detail(spark, sf))


AXES_SQL = f"""m AS (SELECT * FROM u WHERE NOT is_sidechain),
ct AS (SELECT repo, platform, {ratio_sql("count(*) FILTER (WHERE label_field = 'permission_mode' AND label = 'plan')", "count(*) FILTER (WHERE label_field = 'permission_mode')")} AS planning, count(DISTINCT session_id) AS sessions,
  count(DISTINCT CASE WHEN label_field = 'skill' THEN 's:' || label END) + count(DISTINCT CASE WHEN is_call AND starts_with(tool_name, 'mcp__') THEN 'm:' || split_part(tool_name, '__', 2) END) AS extras,
  count(*) FILTER (WHERE is_call AND coalesce({LONG_RUN_SQL.format('command')}, false)) AS tests FROM m GROUP BY 1, 2),
bz AS (SELECT repo, platform, count(DISTINCT session_id) AS n, date_trunc('hour', ts) AS h FROM m GROUP BY repo, platform, date_trunc('hour', ts)),
pl AS (SELECT repo, platform, sum(n - 1)::DOUBLE / count(*) AS parallelism FROM bz GROUP BY 1, 2),
fr AS (SELECT repo, platform, count(*) AS eps, count(*) FILTER (WHERE NOT interrupted)::DOUBLE / count(*) AS autonomy FROM ep GROUP BY 1, 2),
wd AS (SELECT ct.repo, ct.platform, coalesce(autonomy, 0) AS autonomy, planning, coalesce(parallelism, 0) AS parallelism, extras::DOUBLE / sessions::DOUBLE AS investment, {ratio_sql('tests', 'coalesce(eps, 0)')} AS verification
  FROM ct LEFT JOIN pl USING (repo, platform) LEFT JOIN fr USING (repo, platform)),
ax AS (SELECT repo, platform, axis, {round_sql('value', 6)} AS value FROM (UNPIVOT wd ON autonomy, planning, parallelism, investment, verification INTO NAME axis VALUE value))"""


@query("p5_style_axes", EPS + f", {AXES_SQL} SELECT * FROM ax")
def _(spark, sf):
    return P.style_axes(events_as_ev(spark, sf), _detail(spark, sf), "repo")


TARGETS = [("autonomy", 0.9), ("planning", 0.4), ("parallelism", 0.5), ("investment", 2.0), ("verification", 1.0)]


@query("p5_top_gaps", EPS + f""", {AXES_SQL}, tg(axis, target) AS (VALUES {", ".join(f"('{a}', {t}::DOUBLE)" for a, t in TARGETS)}),
gp AS (SELECT repo, platform, axis, value, target, {round_sql('target - value', 6)} AS gap FROM ax JOIN tg USING (axis)),
rk AS (SELECT *, row_number() OVER (PARTITION BY repo, platform ORDER BY abs(gap) DESC, axis) AS place FROM gp)
SELECT repo, platform, place, axis, value, target, gap FROM rk WHERE place <= 3""")
def _(spark, sf):
    axes = P.style_axes(events_as_ev(spark, sf), _detail(spark, sf), "repo")
    return P.top_gaps(axes, spark.createDataFrame(TARGETS, "axis string, target double"), ["repo", "platform"])


@query("p10_autonomy_tier", f"""
WITH r AS (SELECT session_id, count(DISTINCT file_id) AS sessions, count(*) FILTER (WHERE is_edit AND NOT is_sidechain) AS edits,
 {ratio4_sql('count(*) FILTER (WHERE is_edit AND NOT is_sidechain AND k % 5 = 0)', 'count(*) FILTER (WHERE is_edit AND NOT is_sidechain)')} AS umr FROM u GROUP BY 1)
SELECT session_id, CASE WHEN edits::DOUBLE / sessions::DOUBLE < 0.5::DOUBLE THEN 3 WHEN umr >= 0.5::DOUBLE THEN 0 WHEN umr >= 0.15::DOUBLE THEN 1 ELSE 2 END AS tier FROM r""")
def _(spark, sf):
    ev = events_as_ev(spark, sf)
    files = ev.groupBy("session_id").agg(F.count_distinct("file_id").alias("sessions"))
    rework = B.rework_signals(ev, "session_id").select("session_id", "edits", "user_modified_rate")
    return files.join(rework, "session_id", "left").fillna(0).select("session_id", score.autonomy_tier().alias("tier"))


@query("p9_primary_platform_recent", """
WITH l AS (SELECT *, max(ts) OVER (PARTITION BY repo) AS last FROM u)
SELECT repo, sum(n)::BIGINT AS records, CASE WHEN max(n)::DOUBLE / sum(n)::DOUBLE >= 0.8::DOUBLE THEN arg_max(platform, n) END AS primary_platform
FROM (SELECT repo, platform, count(*) AS n FROM l WHERE ts > last - INTERVAL 7 DAY GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    return P.primary_platform(usage_rows(events_as_ev(spark, sf)), "repo", days=7)


#: Target values of four styles on three axes, as a caller would pass them.
STYLES = [("steady", "calls", 0.6), ("steady", "errors", 0.05), ("steady", "prompts", 0.2), ("chatty", "calls", 0.4), ("chatty", "errors", 0.1), ("chatty", "prompts", 0.5),
          ("brute", "calls", 0.7), ("brute", "errors", 0.3), ("brute", "prompts", 0.1), ("careful", "calls", 0.5), ("careful", "errors", 0.2), ("careful", "prompts", 0.3)]


@query("p5_nearest_archetype", f"""
WITH a(archetype, axis, target) AS (VALUES {", ".join(f"('{n}', '{x}', {t}::DOUBLE)" for n, x, t in STYLES)}),
v AS (SELECT user_id, count(*) FILTER (WHERE is_call)::DOUBLE / count(*) AS calls, count(*) FILTER (WHERE is_error)::DOUBLE / count(*) AS errors,
 count(*) FILTER (WHERE event_type = 'signup')::DOUBLE / count(*) AS prompts FROM u GROUP BY 1),
g AS (SELECT user_id, archetype, axis, target - CASE axis WHEN 'calls' THEN calls WHEN 'errors' THEN errors ELSE prompts END AS gap FROM v, a),
d AS (SELECT user_id, archetype, sum(gap * gap ORDER BY axis) AS distance, first(axis ORDER BY -abs(gap), axis) AS largest_gap, first(gap ORDER BY -abs(gap), axis) AS gap FROM g GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY distance, archetype) AS r FROM d)
SELECT user_id, archetype, {ratio4_sql('distance', '1')} AS distance, largest_gap, {ratio4_sql('gap', '1')} AS gap FROM r WHERE r = 1""")
def _(spark, sf):
    u = events_wide(spark, sf)
    n = F.count(F.lit(1))
    share = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0)) / n
    v = u.groupBy("user_id").agg(share(F.col("event_type").isin("view", "click", "purchase")).alias("calls"), share(F.col("is_error")).alias("errors"),
                                 share(F.col("event_type") == "signup").alias("prompts"))
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in ("calls", "errors", "prompts")]))
    vectors = v.select("user_id", axes.alias("x")).select("user_id", "x.axis", "x.value")
    return P.nearest_archetype(vectors, spark.createDataFrame(STYLES, "archetype string, axis string, target double"), ["user_id"])


@query("p7_prompt_history", """
SELECT session_id, epoch_us(ts) // 1000000 * 1000000 AS ts, md5(prompt_text) AS prompt FROM u WHERE event_type = 'signup'""")
def _(spark, sf):
    u = events_wide(spark, sf).filter(F.col("event_type") == "signup")
    record = F.to_json(F.struct("session_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.col("prompt_text").alias("text")))
    good, _ = L.parse_json(u.select("file_id", F.col("event_id").alias("line_no"), record.alias("value")))
    return L.prompt_history(good).select("session_id", "ts", F.md5(F.col("text").cast("binary")).alias("prompt"))
