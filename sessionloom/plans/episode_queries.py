"""Episode, ordered-state and join queries. The idle cap is six hours because the gaps of the table are wide."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..schema import STRIDE
from ..functions import models as M
from ..functions.timez import epoch_micros
from ..operators.compare import platform_summary
from ..operators import episodes as E, filters as FI, joins as J, scan as SC, tokens as T, topk as K, usage as U
from ..session import stage
from .adapters import events_as_ev, events_wide, plan_cache, table
from .registry import NORM, query, ratio4_sql, ratio_sql, round_sql

CAP = 6 * 3600
MAIN = "NOT is_sidechain"

# ---- Reference SQL of the whole episode table, one row per event in, one row per episode out. ----
EP_SQL = f"""
e0 AS (SELECT *, sum(CASE WHEN is_boundary THEN 1 ELSE 0 END) OVER w AS ep, lag(ts) OVER w AS prev_ts, lag(event_id) OVER w AS prev_id,
  max(CASE WHEN is_boundary THEN event_id END) OVER w AS start_id,
  CASE WHEN event_type = 'signup' THEN {{correction}} ELSE false END AS is_corr, {{thinking}} AS is_think, {{long_run}} AS is_long
 FROM u WHERE {MAIN} WINDOW w AS (PARTITION BY file_id ORDER BY event_id)),
e AS (SELECT *, CASE WHEN prev_id >= start_id AND epoch_us(ts) - epoch_us(prev_ts) BETWEEN 1 AND {CAP * 1_000_000} THEN epoch_us(ts) - epoch_us(prev_ts) ELSE 0 END AS gap,
  sum(CASE WHEN is_result AND NOT is_error THEN 1 ELSE 0 END) OVER w AS island,
  sum(CASE WHEN is_call THEN 1 ELSE 0 END) OVER w AS pos,
  row_number() OVER (PARTITION BY file_id, ep, file_base ORDER BY event_id) = 1 AND file_base IS NOT NULL AS first_touch
 FROM e0 WHERE ep > 0 WINDOW w AS (PARTITION BY file_id ORDER BY event_id)),
bd AS (SELECT file_id, ep, event_id AS start_id, ts AS start_ts, platform, session_id, repo, is_think AS thinking_directive,
  coalesce(lead(is_corr) OVER (PARTITION BY file_id ORDER BY event_id), false) AS corrected_by_next,
  row_number() OVER (PARTITION BY session_id ORDER BY file_id, event_id) - 1 AS idx FROM e WHERE is_boundary),
runs AS (SELECT file_id, ep, max(n) AS error_run FROM (SELECT file_id, ep, island, count(*) FILTER (WHERE is_error) AS n FROM e WHERE is_result GROUP BY 1, 2, 3) GROUP BY 1, 2),
files AS (SELECT file_id, ep, count(*) AS files_touched, max(n) AS max_edits_per_file FROM (SELECT file_id, ep, file_base, count(*) FILTER (WHERE is_edit) AS n FROM e WHERE file_base IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
models AS (SELECT file_id, ep, model_norm AS model FROM (SELECT *, row_number() OVER (PARTITION BY file_id, ep ORDER BY t DESC, model_norm) AS r FROM (SELECT file_id, ep, model_norm, sum(total) AS t FROM e GROUP BY 1, 2, 3)) WHERE r = 1),
quiet AS (SELECT file_id, ep, max(n) AS quiet_run FROM (SELECT file_id, ep, run, count(*) FILTER (WHERE is_call AND NOT first_touch) AS n FROM (
  SELECT *, sum(CASE WHEN first_touch THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, ep ORDER BY event_id) AS run FROM e) GROUP BY 1, 2, 3) GROUP BY 1, 2),
f AS (SELECT file_id, ep, sum(input)::BIGINT AS input, sum(cached_input)::BIGINT AS cached_input, sum(output)::BIGINT AS output, sum(reasoning_output)::BIGINT AS reasoning_output,
  sum(cache_creation)::BIGINT AS cache_creation, sum(total)::BIGINT AS total, sum(nano)::DOUBLE / 1e9::DOUBLE AS cost_usd, count(*) FILTER (WHERE is_call) AS tool_calls,
  count(*) FILTER (WHERE is_edit) AS edits, count(*) FILTER (WHERE file_base IS NOT NULL AND NOT is_edit) AS reads, count(*) FILTER (WHERE tool_kind = 'shell') AS shells,
  count(*) FILTER (WHERE tool_kind = 'search') AS searches, count(*) FILTER (WHERE tool_kind IN ('mcp', 'other')) AS others,
  {ratio_sql("count(*) FILTER (WHERE file_ext = 'md')", 'count(file_base)')} AS doc_ratio, {ratio_sql("count(*) FILTER (WHERE file_ext IN ('py', 'ts', 'sql'))", 'count(file_base)')} AS code_ratio,
  count(*) FILTER (WHERE is_result) AS results, count(*) FILTER (WHERE is_error) AS errors, {ratio_sql('count(*) FILTER (WHERE is_error)', 'count(*) FILTER (WHERE is_result)')} AS err,
  bool_or(coalesce(error_category = 'test', false)) AS has_test, bool_or(is_call AND is_long) AS long_run,
  sum(CASE WHEN is_edit THEN k % 10 + k % 4 ELSE 0 END)::BIGINT AS lines, bool_or(coalesce(marker = 'interrupt', false)) AS interrupted, bool_or(coalesce(marker = 'compaction', false)) AS compacted,
  floor(sum(gap)::DOUBLE / 1000.0::DOUBLE)::BIGINT AS active_ms, max(ts) AS last_ts, arg_max(label, event_id) FILTER (WHERE label_field = 'effort') AS effort FROM e GROUP BY 1, 2),
j AS (SELECT bd.*, f.* EXCLUDE (file_id, ep), coalesce(error_run, 0) AS error_run, coalesce(files_touched, 0) AS files_touched, coalesce(max_edits_per_file, 0) AS max_edits_per_file,
  model, quiet_run, reads + edits + searches + shells + others AS acts FROM bd JOIN f USING (file_id, ep) LEFT JOIN runs USING (file_id, ep) LEFT JOIN files USING (file_id, ep) LEFT JOIN models USING (file_id, ep)
  LEFT JOIN quiet USING (file_id, ep) WHERE total > 0 OR tool_calls > 0),
s AS (SELECT *, CASE WHEN doc_ratio >= 0.6::DOUBLE AND edits > 0 THEN 0.6::DOUBLE + doc_ratio * 0.4::DOUBLE ELSE 0 END AS s1,
  CASE WHEN long_run THEN 0.7::DOUBLE + CASE WHEN edits = 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END ELSE 0 END AS s2,
  CASE WHEN err >= 0.4::DOUBLE AND edits > 0 AND files_touched <= 3 THEN 0.5::DOUBLE + err * 0.4::DOUBLE ELSE 0 END AS s3,
  CASE WHEN files_touched >= 6 AND (lines >= 400 OR edits >= 10) THEN 0.7::DOUBLE + least(0.3::DOUBLE, files_touched::DOUBLE / 40.0::DOUBLE) ELSE 0 END AS s4,
  CASE WHEN edits >= 3 AND (has_test OR code_ratio >= 0.5::DOUBLE) THEN 0.5::DOUBLE + least(0.4::DOUBLE, edits::DOUBLE / 25.0::DOUBLE) ELSE 0 END AS s5,
  CASE WHEN reads + searches >= 4 AND edits <= 1 THEN 0.5::DOUBLE + least(0.4::DOUBLE, (reads + searches)::DOUBLE / 25.0::DOUBLE) ELSE 0 END AS s6,
  CASE WHEN edits >= 1 AND NOT has_test AND acts <= 6 AND files_touched <= 2 THEN 0.45::DOUBLE ELSE 0 END AS s7 FROM j),
t AS (SELECT *, greatest(s1, s2, s3, s4, s5, s6, s7) AS best FROM s),
ty AS (SELECT *, CASE WHEN acts < 2 OR best < 0.4::DOUBLE THEN 'unknown' WHEN s1 = best THEN 'docs' WHEN s2 = best THEN 'experiment' WHEN s3 = best THEN 'debug' WHEN s4 = best THEN 'refactor'
   WHEN s5 = best THEN 'implement' WHEN s6 = best THEN 'explore' ELSE 'scripting' END AS task_type,
  {round_sql('CASE WHEN acts < 2 THEN 0.1::DOUBLE WHEN best < 0.4::DOUBLE THEN least(0.39::DOUBLE, best) ELSE least(1.0::DOUBLE, best) END', 2)} AS task_type_confidence,
  max_edits_per_file >= 3 AS edit_ring, error_run >= 3 OR (err >= 0.5::DOUBLE AND results >= 4 AND files_touched <= 3) AS error_dense,
  coalesce(quiet_run, 0) >= 4 AND (edits > 0 OR errors > 0) AS no_progress,
  CASE WHEN interrupted THEN 'interrupted' WHEN corrected_by_next THEN 'corrected' ELSE 'natural' END AS end_type FROM t),
p90 AS (SELECT task_type, quantile_disc(active_ms, 0.9) AS type_p90, count(*) AS type_rows FROM ty GROUP BY 1),
o AS (SELECT ty.*, type_rows < 5 AS low_confidence,
  active_ms > CASE WHEN type_rows < 5 THEN (SELECT quantile_disc(active_ms, 0.9) FROM ty) ELSE type_p90 END AND active_ms > 300000 AS time_outlier FROM ty JOIN p90 USING (task_type)),
ep AS (SELECT file_id, ep, platform, session_id, repo, idx AS index, start_ts, greatest(start_ts, last_ts) AS end_ts, active_ms // 1000 AS duration_seconds,
  input, cached_input, output, reasoning_output, cache_creation, total, cost_usd, tool_calls, files_touched, max_edits_per_file, errors AS error_count,
  {round_sql('err')} AS error_rate, interrupted, end_type, task_type, task_type_confidence, edit_ring, error_dense, no_progress, time_outlier, low_confidence,
  2 * edit_ring::INT + 2 * error_dense::INT + no_progress::INT + time_outlier::INT AS severity, effort, model, thinking_directive, compacted FROM o)"""


def _fill() -> str:
    from .registry import CORRECTION_SQL, LONG_RUN_SQL, THINKING_SQL
    return EP_SQL.format(correction=CORRECTION_SQL.format("prompt_text"), thinking=f"coalesce({THINKING_SQL.format('prompt_text')}, false)",
                         long_run=f"coalesce({LONG_RUN_SQL.format('command')}, false)")


EP_FILLED = _fill()
EPS = f"WITH {EP_FILLED}\n"


@plan_cache
def _raw(spark, sf):
    """Episodes before they are compared with each other, written once per session and folder."""
    return stage(E.raw_episodes(events_as_ev(spark, sf), CAP), "episodes")


@plan_cache
def _detail(spark, sf):
    """The finished episode table is written once per session and folder; its summaries read the written table."""
    return stage(E.finished(_raw(spark, sf)), "episode-detail")


@query("w2_active_seconds", f"""
WITH a AS (SELECT file_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY file_id ORDER BY event_id)) AS gap FROM u WHERE {MAIN})
SELECT file_id, sum(CASE WHEN gap BETWEEN 1 AND {CAP * 1_000_000} THEN gap ELSE 0 END)::BIGINT // 1000000 AS active_seconds FROM a GROUP BY 1""")
def _(spark, sf):
    return T.active_seconds(events_as_ev(spark, sf), CAP, "file_id")


@query("w3_w4_w5_boundaries", EPS + "SELECT file_id, ep, start_id AS event_id, idx AS index, session_id, corrected_by_next, thinking_directive FROM bd")
def _(spark, sf):
    b = E.boundaries(events_as_ev(spark, sf))
    return b.select("file_id", "ep", F.expr(f"start_seq div {STRIDE}").alias("event_id"), "index", "session_id", "corrected_by_next", "thinking_directive")


@query("w6_error_runs", EPS + "SELECT * FROM runs")
def _(spark, sf):
    return E.error_runs(events_as_ev(spark, sf))


@query("w7_quiet_runs", EPS + "SELECT file_id, ep, quiet_run FROM quiet JOIN (SELECT file_id, ep FROM e WHERE is_call GROUP BY 1, 2) USING (file_id, ep)")
def _(spark, sf):
    return E.quiet_runs(E.episode_facets(E.label_episodes(events_as_ev(spark, sf), CAP)))


@query("w8_edit_stats", EPS + "SELECT * FROM files")
def _(spark, sf):
    return E.edit_stats(events_as_ev(spark, sf))


@query("w9_dominant_model", EPS + "SELECT file_id, ep, model FROM models")
def _(spark, sf):
    return E.dominant_model(events_as_ev(spark, sf))


@query("w11_type_p90", EPS + "SELECT task_type, type_p90 AS q_value, type_rows AS rows FROM p90")
def _(spark, sf):
    return E.nearest_rank(_raw(spark, sf), ["task_type"], "active_ms", 0.9)


@query("w10_w12_spiral_severity", EPS + "SELECT file_id, ep, edit_ring, error_dense, no_progress, time_outlier, low_confidence, severity FROM ep")
def _(spark, sf):
    return _detail(spark, sf).select("file_id", "ep", "edit_ring", "error_dense", "no_progress", "time_outlier", "low_confidence", "severity")


@query("w13_w14_task_features", EPS + "SELECT file_id, ep, reads, edits, searches, shells, others, files_touched, has_test, long_run, doc_ratio, code_ratio, lines, err AS error_rate_raw, task_type, task_type_confidence FROM ty")
def _(spark, sf):
    return E.raw_episodes(events_as_ev(spark, sf), CAP).select(
        "file_id", "ep", "reads", "edits", "searches", "shells", "others", "files_touched", "has_test", "long_run", "doc_ratio", "code_ratio",
        "lines", "error_rate_raw", "task_type", "task_type_confidence")


@query("w19_episode_detail", EPS + "SELECT * REPLACE (epoch_us(start_ts) AS start_ts, epoch_us(end_ts) AS end_ts) FROM ep")
def _(spark, sf):
    return _detail(spark, sf)


SUMMARY = f"""SELECT count(*) AS episodes, {round_sql("1.0::DOUBLE - " + ratio_sql('count(*) FILTER (WHERE interrupted)', 'count(*)'))} AS autonomy_rate,
 {ratio4_sql('count(*) FILTER (WHERE interrupted)', 'count(*)')} AS interrupted_rate, {ratio4_sql("count(*) FILTER (WHERE end_type = 'corrected')", 'count(*)')} AS corrected_rate,
 CASE WHEN count(*) FILTER (WHERE interrupted)::DOUBLE / count(*)::DOUBLE + count(*) FILTER (WHERE end_type = 'corrected')::DOUBLE / count(*)::DOUBLE >= 0.35::DOUBLE THEN 'micro-manager'
  WHEN count(*) FILTER (WHERE interrupted)::DOUBLE / count(*)::DOUBLE + count(*) FILTER (WHERE end_type = 'corrected')::DOUBLE / count(*)::DOUBLE <= 0.1::DOUBLE THEN 'free-range' ELSE 'balanced' END AS intervention_style,
 count(*) FILTER (WHERE severity > 0) AS spiral_episodes FROM ep"""


@query("w15_episode_summary", EPS + SUMMARY)
def _(spark, sf):
    return E.episode_summary(_detail(spark, sf))


@query("w15_summary_by_platform", EPS + SUMMARY.replace("SELECT ", "SELECT platform, ", 1) + " GROUP BY platform")
def _(spark, sf):
    return E.episode_summary(_detail(spark, sf), "platform")


@query("a42_summary_with_episodes", EPS + ", sp AS (" + SUMMARY.replace("SELECT ", "SELECT platform, ", 1) + """ GROUP BY platform),
su AS (SELECT platform, sum(total)::BIGINT AS total, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM u GROUP BY 1)
SELECT * FROM su LEFT JOIN sp USING (platform)""")
def _(spark, sf):
    whole = platform_summary(events_as_ev(spark, sf), episodes=_detail(spark, sf))
    return whole.select("platform", "total", "first_day", "last_day", *[c for c in E.episode_summary(_detail(spark, sf)).columns])


@query("w15_task_mix", EPS + f"SELECT task_type, count(*) AS episodes, {ratio4_sql('count(*)', '(SELECT count(*) FROM ep)')} AS share FROM ep GROUP BY 1")
def _(spark, sf):
    return E.task_mix(_detail(spark, sf))


@query("w16_deepest_pit", EPS + "SELECT session_id, index, severity, total AS tokens, task_type FROM ep WHERE severity > 0 ORDER BY severity * total DESC, file_id, ep LIMIT 1")
def _(spark, sf):
    return E.deepest_pit(_detail(spark, sf))


def mean_sql(c: str) -> str:
    return f"floor(sum({c})::DOUBLE / count(*)::DOUBLE + 0.5::DOUBLE)"


@query("w17_effort_calibration", EPS + f""", d AS (
 SELECT 'effort' AS dial, effort AS value, * FROM ep WHERE effort IS NOT NULL UNION ALL SELECT 'model', model, * FROM ep WHERE model <> ''
 UNION ALL SELECT 'thinking', CASE WHEN thinking_directive THEN 'on' ELSE 'off' END, * FROM ep WHERE starts_with(model, 'claude') AND (SELECT bool_or(thinking_directive AND starts_with(model, 'claude')) FROM ep))
SELECT dial, value, task_type, count(*) AS episodes, {ratio4_sql('count(*) FILTER (WHERE severity > 0)', 'count(*)')} AS spiral_rate,
 {ratio4_sql("count(*) FILTER (WHERE end_type = 'corrected')", 'count(*)')} AS corrected_rate, {mean_sql('duration_seconds')} AS avg_duration_seconds,
 {mean_sql('total')} AS avg_total_tokens, {mean_sql('reasoning_output')} AS avg_reasoning_tokens, count(*) < 5 AS low_confidence FROM d GROUP BY 1, 2, 3""")
def _(spark, sf):
    return E.effort_calibration(_detail(spark, sf))


ROT = f"""bk AS (SELECT least(index // 5, 4) * 5 AS index_from, count(*) AS episodes, {ratio4_sql('count(*) FILTER (WHERE severity > 0)', 'count(*)')} AS spiral_rate,
 {ratio4_sql("count(*) FILTER (WHERE end_type = 'corrected')", 'count(*)')} AS corrected_rate, {ratio4_sql("count(*) FILTER (WHERE severity > 0 OR end_type = 'corrected')", 'count(*)')} AS rot_rate,
 {round_sql("sum(floor(error_rate * 10000 + 0.5::DOUBLE)::BIGINT)::DOUBLE / (count(*) * 10000)::DOUBLE")} AS avg_error_rate FROM ep GROUP BY 1)"""


@query("w18_context_rot_buckets", EPS + f", {ROT} SELECT * FROM bk")
def _(spark, sf):
    return E.context_rot_buckets(_detail(spark, sf))


@query("w18_context_rot", EPS + f""", {ROT}, h AS (SELECT arg_min(rot_rate, index_from) AS base, min(index_from) AS base_from, count(*) AS n FROM bk WHERE episodes >= 5)
SELECT coalesce((SELECT base FROM h), 0.0::DOUBLE) AS baseline_rot_rate, n < 2 AS low_confidence,
 (SELECT min(index_from) FROM bk WHERE episodes >= 5 AND index_from > h.base_from AND rot_rate >= greatest(2 * h.base, h.base + 0.15::DOUBLE)) AS inflection_index FROM h""")
def _(spark, sf):
    return E.context_rot(_detail(spark, sf))


@query("t5_top_episodes", EPS + "SELECT file_id, ep, severity, total FROM ep ORDER BY severity DESC, total DESC, file_id, ep LIMIT 200")
def _(spark, sf):
    return K.top_episodes(_detail(spark, sf)).select("file_id", "ep", "severity", "total")


@query("f12_nonempty_episodes", EPS + "SELECT (SELECT count(*) FROM bd) AS starts, count(*) AS episodes FROM ep")
def _(spark, sf):
    ev = events_as_ev(spark, sf)
    starts = E.boundaries(ev).agg(F.count(F.lit(1)).alias("starts"))
    kept = E.raw_episodes(ev, CAP).agg(F.count(F.lit(1)).alias("episodes"))
    return starts.select("starts", kept.scalar().alias("episodes"))


@query("j15_corrected_by_next", EPS + "SELECT file_id, ep, corrected_by_next FROM bd WHERE corrected_by_next")
def _(spark, sf):
    return E.boundaries(events_as_ev(spark, sf)).filter("corrected_by_next").select("file_id", "ep", "corrected_by_next")


# ---- Mixed counters: cumulative totals run down each file, per-turn values are present on two rows of three. ----
@query("w1_token_deltas", """
WITH c AS (SELECT file_id, event_id, input, cached_input, output, reasoning_output, event_id % 3 <> 0 AS has_last, event_id % 7 <> 0 AS has_total,
  sum(input) OVER w AS ti, sum(cached_input) OVER w AS tc, sum(output) OVER w AS tout, sum(reasoning_output) OVER w AS tr
  FROM u WINDOW w AS (PARTITION BY file_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT * FROM c WHERE has_last OR has_total),
g AS (SELECT *, sum(CASE WHEN has_total THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY event_id) AS g FROM r),
st AS (SELECT *, coalesce(max(CASE WHEN has_total THEN ti END) OVER q, 0) + sum(CASE WHEN NOT has_total THEN input ELSE 0 END) OVER q AS si,
  coalesce(max(CASE WHEN has_total THEN tc END) OVER q, 0) + sum(CASE WHEN NOT has_total THEN cached_input ELSE 0 END) OVER q AS sc,
  coalesce(max(CASE WHEN has_total THEN tout END) OVER q, 0) + sum(CASE WHEN NOT has_total THEN output ELSE 0 END) OVER q AS so,
  coalesce(max(CASE WHEN has_total THEN tr END) OVER q, 0) + sum(CASE WHEN NOT has_total THEN reasoning_output ELSE 0 END) OVER q AS sr
 FROM g WINDOW q AS (PARTITION BY file_id, g ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT *, coalesce(lag(si) OVER w, 0) AS pi, coalesce(lag(sc) OVER w, 0) AS pc, coalesce(lag(so) OVER w, 0) AS po, coalesce(lag(sr) OVER w, 0) AS prr FROM st WINDOW w AS (PARTITION BY file_id ORDER BY event_id)),
d AS (SELECT file_id, event_id, CASE WHEN has_last THEN input ELSE greatest(0, ti - pi) END AS input, CASE WHEN has_last THEN cached_input ELSE greatest(0, tc - pc) END AS cached,
  CASE WHEN has_last THEN output ELSE greatest(0, tout - po) END AS output, CASE WHEN has_last THEN reasoning_output ELSE greatest(0, tr - prr) END AS reasoning_output FROM pr)
SELECT file_id, event_id, input::BIGINT AS input, least(cached, input)::BIGINT AS cached_input, output::BIGINT AS output, reasoning_output::BIGINT AS reasoning_output, (input + output)::BIGINT AS total FROM d""")
def _(spark, sf):
    u = events_wide(spark, sf)
    cols = ("input", "cached_input", "output", "reasoning_output")
    cumulative = SC.ordered_scan(u.select("file_id", F.col("event_id").alias("seq"), *cols), ["file_id"], "seq",
                                 [SC.running_sum(f"total_{c}", F.col(c)) for c in cols])
    rows = stage(cumulative, "counters").select(
        "file_id", "seq", *[F.col(c).alias(f"last_{c}") for c in cols], *[f"total_{c}" for c in cols],
        F.lit(0).cast("bigint").alias("last_total"), F.lit(0).cast("bigint").alias("total_total"),
        (F.col("seq") % 3 != 0).alias("has_last"), (F.col("seq") % 7 != 0).alias("has_total"))
    return T.token_deltas(rows).select("file_id", F.col("seq").alias("event_id"), *cols, "total")


# ---- Deduplication and joins. ----
def _keyed(spark, sf):
    key = F.when(F.col("event_id") % 10 != 0, F.concat(F.col("user_id"), F.lit(":"), F.expr("event_id div 3")))
    return events_wide(spark, sf).select(
        "file_id", F.col("event_id").alias("seq"), key.alias("dedup_key"), "ts", "input", "cached_input", "output", "reasoning_output", "cache_creation", "total")


KEYED = "k0 AS (SELECT *, CASE WHEN event_id % 10 <> 0 THEN user_id || ':' || event_id // 3 END AS dk FROM u)"
FIRST = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dk ORDER BY file_id, event_id) AS r FROM k0 WHERE ts >= TIMESTAMP '2024-01-10') WHERE dk IS NULL OR r = 1)"


def _late(rows):
    return rows.filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))


@query("j1_dedup_records", f"WITH {KEYED}, {FIRST} SELECT file_id, event_id FROM f")
def _(spark, sf):
    return J.dedup_records(_late(_keyed(spark, sf))).select("file_id", F.col("seq").alias("event_id"))


@query("j2_max_usage", f"""WITH {KEYED}, {FIRST},
m AS (SELECT * FROM (SELECT dk, input, cached_input, output, cache_creation, total, row_number() OVER (PARTITION BY dk ORDER BY total DESC, file_id, event_id) AS r FROM k0 WHERE dk IS NOT NULL) WHERE r = 1)
SELECT f.event_id, coalesce(m.input, f.input) AS input, coalesce(m.output, f.output) AS output, coalesce(m.total, f.total) AS total FROM f LEFT JOIN m USING (dk)""")
def _(spark, sf):
    rows = _keyed(spark, sf)
    return J.dedup_with_max_usage(_late(rows), rows).select(F.col("seq").alias("event_id"), "input", "output", "total")


@query("j3_tool_name_for_result", """
WITH d AS (SELECT call, arg_max(tool_name, file_id || lpad(CAST(event_id AS VARCHAR), 12, '0')) AS name FROM (SELECT *, user_id || '-' || k % 9 AS call FROM u WHERE is_call) GROUP BY 1)
SELECT event_id, coalesce(name, '(unknown)') AS tool_name FROM (SELECT *, user_id || '-' || k % 9 AS call FROM u WHERE is_result) LEFT JOIN d USING (call)""")
def _(spark, sf):
    u = events_wide(spark, sf).withColumn("call_id", F.concat("user_id", F.lit("-"), F.col("k") % 9)).withColumn("seq", F.col("event_id"))
    uses = u.filter(F.col("event_type").isin("view", "click", "purchase"))
    return J.tool_name_for_result(u.filter(F.col("event_type") == "error"), uses).select("event_id", "tool_name")


@query("j4_exit_codes", """
WITH x AS (SELECT file_id, event_id, k % 3 AS call_id, CASE WHEN event_type = 'click' THEN k % 2 END AS event_exit, event_type = 'error' AS is_output, CASE WHEN k % 4 = 1 THEN 7 END AS parsed FROM u),
l AS (SELECT *, last_value(event_exit IGNORE NULLS) OVER (PARTITION BY file_id, call_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM x)
SELECT event_id, coalesce(seen, parsed) AS exit_code, coalesce(coalesce(seen, parsed) <> 0, false) AS is_error FROM l WHERE is_output""")
def _(spark, sf):
    k, et = F.col("k"), F.col("event_type")
    rows = events_wide(spark, sf).select(
        "file_id", F.col("event_id").alias("seq"), (k % 3).alias("call_id"), F.when(et == "click", k % 2).alias("event_exit"),
        (et == "error").alias("is_output"), F.when(k % 4 == 1, F.lit(7).cast("bigint")).alias("parsed_exit"))
    return J.exit_code_for_output(rows).select(F.col("seq").alias("event_id"), "exit_code", "is_error")


@query("j5_session_source", "SELECT session_id, source FROM (SELECT session_id, source, row_number() OVER (PARTITION BY session_id ORDER BY file_id, event_id) AS r FROM u WHERE source <> '') WHERE r = 1")
def _(spark, sf):
    return U.session_source(events_as_ev(spark, sf))


@query("j9_carry_state", """
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN model END IGNORE NULLS) OVER w AS cur_model, last_value(CASE WHEN k % 6 = 0 THEN repo END IGNORE NULLS) OVER w AS cur_repo,
 first_value(CASE WHEN k % 5 = 0 THEN session_id END IGNORE NULLS) OVER w AS cur_session, first_value(nullif(source, '') IGNORE NULLS) OVER w AS cur_source
FROM u WINDOW w AS (PARTITION BY file_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    k = F.col("k")
    rows = events_wide(spark, sf).select(
        "file_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", F.col("model")).alias("set_model"),
        F.when(k % 6 == 0, F.col("repo")).alias("set_repo"), F.when(k % 5 == 0, F.col("session_id")).alias("set_session"), F.col("source").alias("set_source"))
    return J.carry_state(rows).select(F.col("seq").alias("event_id"), "cur_model", "cur_repo", "cur_session", "cur_source")


@query("j10_commits_in_session", """
WITH s AS (SELECT o_custkey AS cust, min(o_orderdate) AS f, min(o_orderdate) + INTERVAL '60 days' AS l FROM orders GROUP BY 1),
c AS (SELECT o_custkey AS cust, l_orderkey, l_linenumber, l_shipdate AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT cust, count(*) AS commits, min(l_orderkey) AS first_order FROM s JOIN c USING (cust) WHERE t BETWEEN f AND l GROUP BY 1""", on_u=False)
def _(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    sessions = o.groupBy(F.col("o_custkey").alias("repo")).agg(F.min("o_orderdate").alias("first_ts")).withColumn("last_ts", F.col("first_ts") + F.expr("INTERVAL 60 DAY"))
    commits = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("repo"), "l_orderkey", F.col("l_shipdate").alias("commit_ts"))
    hits = J.commits_in_session(sessions, commits)
    return hits.groupBy(F.col("repo").alias("cust")).agg(F.count(F.lit(1)).alias("commits"), F.min("l_orderkey").alias("first_order"))


@query("j11_reconcile", """
WITH a AS (SELECT o_orderkey AS k, CAST(round(o_totalprice) AS BIGINT) % 4 AS tokens, o_totalprice AS cost FROM orders WHERE o_orderkey % 11 <> 0),
b AS (SELECT l_orderkey AS k, max(l_linenumber)::BIGINT % 4 AS tokens, max(l_extendedprice) * 3 AS cost FROM lineitem GROUP BY 1)
SELECT CASE WHEN a.tokens IS NULL OR b.tokens IS NULL THEN 'skipped' WHEN a.tokens = b.tokens AND abs(a.cost - b.cost) / greatest(abs(b.cost), 1e-9) <= 0.01::DOUBLE THEN 'ok' ELSE 'fail' END AS status,
 count(*) AS n FROM a FULL OUTER JOIN b USING (k) GROUP BY 1""", on_u=False)
def _(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    ours = o.filter(F.col("o_orderkey") % 11 != 0).select(F.col("o_orderkey").alias("k"), (F.round("o_totalprice").cast("bigint") % 4).alias("tokens"), F.col("o_totalprice").alias("cost"))
    theirs = l.groupBy(F.col("l_orderkey").alias("k")).agg((F.max("l_linenumber").cast("bigint") % 4).alias("tokens"), (F.max("l_extendedprice") * 3).alias("cost"))
    return J.reconcile(ours, theirs, ["k"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
