"""Queries on tools, commands, version control, files, errors, rework, labels and scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..schema import STRIDE
from ..functions import text as X
from ..operators import behavior as B, compare as CO, joins as J, sessions as S, topk as K, usage as U
from .adapters import events_as_ev, events_wide, table, texts
from .registry import first_token_sql, git_sql, query, ratio4_sql, ratio_sql, round_sql

MAIN = "NOT is_sidechain"
CALLS = f"is_call AND {MAIN}"


@query("a9_tool_categories", f"SELECT platform, tool_kind, count(*) AS calls FROM u WHERE {CALLS} GROUP BY 1, 2")
def _(spark, sf):
    return B.tool_categories(events_as_ev(spark, sf), "platform")


@query("a9_tool_totals", f"""
SELECT count(*) FILTER (WHERE tool_kind = 'shell') AS shell_calls, count(*) FILTER (WHERE tool_kind = 'web') AS web_searches,
 count(*) FILTER (WHERE tool_kind = 'file') AS file_changes, count(*) AS total_calls FROM u WHERE {CALLS}""")
def _(spark, sf):
    return B.tool_totals(events_as_ev(spark, sf))


@query("a10_tools_by_name", f"SELECT tool_name AS name, count(*) AS calls FROM u WHERE {CALLS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def _(spark, sf):
    return B.tools_by_name(events_as_ev(spark, sf))


@query("a11_mcp_usage", f"""
WITH m AS (SELECT string_split(substr(tool_name, 6), '__')[1] AS server, string_split(substr(tool_name, 6), '__')[2] AS tool FROM u WHERE tool_kind = 'mcp' AND {MAIN})
SELECT CASE grouping(server, tool) WHEN 0 THEN 'tool' WHEN 1 THEN 'server' ELSE 'total' END AS level, server, tool, count(*) AS calls FROM m GROUP BY ROLLUP (server, tool)""")
def _(spark, sf):
    return B.mcp_usage(events_as_ev(spark, sf))


@query("a12_top_commands", f"SELECT command, count(*) AS calls FROM (SELECT {first_token_sql('command')} AS command FROM u WHERE tool_kind = 'shell' AND {MAIN}) WHERE command <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def _(spark, sf):
    return B.top_commands(events_as_ev(spark, sf))


@query("a13_git_counts", f"SELECT command, count(*) AS calls FROM (SELECT {git_sql('command')} AS command FROM u WHERE tool_kind = 'shell' AND {MAIN}) WHERE command IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return B.git_counts(events_as_ev(spark, sf))


@query("a13_git_habits", f"""
WITH g AS (SELECT {git_sql('command')} AS c FROM u WHERE tool_kind = 'shell' AND {MAIN}),
n AS (SELECT count(c) AS command_count, count(*) FILTER (WHERE c = 'status') AS st, count(*) FILTER (WHERE c = 'diff') AS df,
 count(*) FILTER (WHERE c IN ('log', 'show')) AS hi, count(*) FILTER (WHERE c = 'commit') AS co, count(*) FILTER (WHERE c = 'push') AS pu FROM g),
b AS (SELECT repo, count(DISTINCT branch) AS b FROM u GROUP BY 1)
SELECT command_count, (SELECT sum(b)::BIGINT FROM b) AS branch_count, (SELECT count(*) FROM b WHERE b > 1) AS multi_branch_repos,
 st > 0 AS reviews_status, df > 0 AS reviews_diff, hi > 0 AS reviews_history, co = 0 AND (df > 0 OR st > 0) AS risk_no_commit, pu > 0 AS risk_push FROM n""")
def _(spark, sf):
    ev = events_as_ev(spark, sf)
    return B.git_habits(ev, U.repo_branches(ev))


LANG = "CASE {0} WHEN 'py' THEN 'Python' WHEN 'ts' THEN 'TypeScript' WHEN 'md' THEN 'Markdown' WHEN 'sql' THEN 'SQL' ELSE upper({0}) END"


@query("a14_file_languages", f"SELECT {LANG.format('file_ext')} AS name, count(*) AS files FROM u WHERE tool_kind = 'file' AND {MAIN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def _(spark, sf):
    return B.file_languages(events_as_ev(spark, sf))


@query("a15_dominant_language", f"""
SELECT repo, language FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, file_ext) AS r FROM (
 SELECT repo, file_ext, {LANG.format('file_ext')} AS language, count(*) AS n FROM u WHERE tool_kind = 'file' AND {MAIN} AND file_ext <> 'md' GROUP BY 1, 2, 3)) WHERE r = 1""")
def _(spark, sf):
    return B.dominant_language(events_as_ev(spark, sf))


ERR = f"""count(*) FILTER (WHERE is_result) AS results, count(*) FILTER (WHERE is_error) AS errors,
 {ratio4_sql('count(*) FILTER (WHERE is_error)', 'count(*) FILTER (WHERE is_result)')} AS error_rate,
 count(*) FILTER (WHERE marker = 'interrupt') AS interrupted, count(*) FILTER (WHERE marker = 'api_error') AS api_errors"""


@query("a16_error_signals", f"SELECT repo, {ERR} FROM u WHERE {MAIN} GROUP BY 1")
def _(spark, sf):
    return B.error_signals(events_as_ev(spark, sf), "repo")


@query("a16_errors_by_tool", f"SELECT tool_name AS name, count(*) AS errors FROM u WHERE is_error AND {MAIN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def _(spark, sf):
    return B.errors_by(events_as_ev(spark, sf), "tool_name")


@query("a16_errors_by_category", f"SELECT error_category AS name, count(*) AS errors FROM u WHERE is_error AND {MAIN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def _(spark, sf):
    return B.errors_by(events_as_ev(spark, sf), "error_category")


@query("a17_rework_signals", f"""
SELECT repo, count(*) AS edits, count(*) FILTER (WHERE k % 5 = 0) AS user_modified, {ratio4_sql('count(*) FILTER (WHERE k % 5 = 0)', 'count(*)')} AS user_modified_rate,
 sum(k % 10)::BIGINT AS lines_added, sum(k % 4)::BIGINT AS lines_removed FROM u WHERE is_edit AND {MAIN} GROUP BY 1""")
def _(spark, sf):
    return B.rework_signals(events_as_ev(spark, sf), "repo")


@query("a18_skill_usage", """
SELECT label AS skill, CASE WHEN contains(label, ':') THEN string_split(label, ':')[1] END AS plugin,
 CASE WHEN contains(label, ':') THEN string_split(label, ':')[2] ELSE label END AS short, count(*) AS n
FROM u WHERE label_field = 'skill' GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1 LIMIT 12""")
def _(spark, sf):
    return B.skill_usage(events_as_ev(spark, sf))


@query("a19_environment", """
SELECT label_field AS field, label, count(*) AS n FROM u WHERE label_field IN ('version', 'permission_mode') GROUP BY 1, 2
UNION ALL SELECT marker, '', count(*) FROM u WHERE marker IN ('attachment', 'subagent') GROUP BY 1""")
def _(spark, sf):
    return B.environment(events_as_ev(spark, sf))


@query("a21_exec_profile", f"""
SELECT label_field AS field, label, count(*) AS n FROM u WHERE label_field IN ('effort', 'approval_policy', 'sandbox') AND {MAIN} GROUP BY 1, 2
UNION ALL SELECT marker, '', count(*) FROM u WHERE marker IN ('compaction', 'abort') GROUP BY 1""")
def _(spark, sf):
    return B.exec_profile(events_as_ev(spark, sf))


@query("a22_context_window", f"""
SELECT size AS context_window FROM (SELECT CASE WHEN k % 2 = 0 THEN 200000 ELSE 400000 END AS size, count(*) AS n FROM u WHERE {MAIN} GROUP BY 1) ORDER BY n DESC, size LIMIT 1""")
def _(spark, sf):
    return B.context_window(events_as_ev(spark, sf))


# Flags of the prompt corpus lines, written out per line: structured, file_ref, constraint, correction.
PROMPT_FLAGS_SQL = r"""
 length(t) AS len,
 (contains(t, '```') OR regexp_matches(t, '(^|\n)\s*([-*•]|\d+[.)])\s+'))::INT AS structured,
 regexp_matches(t, '@[\w\-]*[./][\w./\-]+|(?:[\w\-]+/)+[\w\-.]*\.(?:py|go|js|jsx|ts|tsx|rs|java|kt|swift|c|h|cc|cpp|cxx|hpp|rb|php|cs|sh|bash|zsh|html|htm|css|scss|less|md|json|yaml|yml|toml|xml|sql|vue|svelte|dart|scala|lua|ipynb|cfg|ini|env|gradle|proto|txt|lock|mod)\b|\b[\w\-]+\.(?:py|go|js|jsx|ts|tsx|rs|java|kt|swift|c|h|cc|cpp|cxx|hpp|rb|php|cs|sh|bash|zsh|html|htm|css|scss|less|md|json|yaml|yml|toml|xml|sql|vue|svelte|dart|scala|lua|ipynb|cfg|ini|env|gradle|proto|txt|lock|mod)\b', 'i')::INT AS file_ref,
 (regexp_matches(lower(t), 'must|should|don''t|do not|only|never|ensure|require|avoid|without|acceptance') OR regexp_matches(t, '必须|应该|不要|不能|只|确保|需要|避免|禁止|验收|务必'))::INT AS constr,
 (regexp_matches(lower(t), '^(actually|instead|wait|no,|no |not |sorry|oops|rather)') OR regexp_matches(t, '^(不对|重来|不是|错了|应该是|改成|其实|等等|算了)'))::INT AS correction"""
SIGNALS_SQL = f"""count(*) AS prompts, {round_sql(ratio_sql('sum(len)', 'count(*)'), 1)} AS avg_len, {ratio4_sql('sum(structured)', 'count(*)')} AS structured_ratio,
 {ratio4_sql('sum(file_ref)', 'count(*)')} AS file_ref_ratio, {ratio4_sql('sum(constr)', 'count(*)')} AS constraint_ratio, {ratio4_sql('sum(correction)', 'count(*)')} AS correction_rate"""


@query("a24_project_buckets", f"""
WITH p AS (SELECT repo AS scope_key, {PROMPT_FLAGS_SQL} FROM (SELECT repo, trim(prompt_text) AS t FROM u WHERE is_boundary)),
s AS (SELECT scope_key, {SIGNALS_SQL} FROM p GROUP BY 1),
b AS (SELECT repo AS scope_key, sum(total)::BIGINT AS tokens, count(*) FILTER (WHERE {CALLS}) AS tool_calls,
 {ratio4_sql('sum(cached_input)', 'sum(cached_input) + sum(fresh)')} AS cache_hit_rate, count(DISTINCT CASE WHEN {MAIN} THEN session_id END) AS sessions,
 (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS duration_seconds,
 {', '.join(f"count(*) FILTER (WHERE {CALLS} AND tool_kind = '{k}') AS {k}_calls" for k in B.TOOL_KINDS)} FROM u GROUP BY 1)
SELECT b.*, coalesce(prompts, 0) AS prompts, {', '.join(f'coalesce({c}, 0.0::DOUBLE) AS {c}' for c in ('avg_len', 'structured_ratio', 'file_ref_ratio', 'constraint_ratio', 'correction_rate'))}
FROM b LEFT JOIN s USING (scope_key)""")
def _(spark, sf):
    return B.scope_buckets(events_as_ev(spark, sf), "project")


@query("a24_session_buckets", f"""
SELECT session_id AS scope_key, sum(total)::BIGINT AS tokens, count(*) FILTER (WHERE is_call) AS tool_calls,
 {ratio4_sql('sum(cached_input)', 'sum(cached_input) + sum(fresh)')} AS cache_hit_rate, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS duration_seconds,
 count(*) FILTER (WHERE is_boundary) AS prompts FROM u WHERE {MAIN} GROUP BY 1""")
def _(spark, sf):
    return B.scope_buckets(events_as_ev(spark, sf), "session").select(
        "scope_key", "tokens", "tool_calls", "cache_hit_rate", "duration_seconds", "prompts")


@query("a24_scope_git_top", f"""
SELECT scope_key, command, calls, rank FROM (SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY calls DESC, command) AS rank FROM (
 SELECT repo AS scope_key, {git_sql('command')} AS command, count(*) AS calls FROM u WHERE tool_kind = 'shell' AND {MAIN} GROUP BY 1, 2) WHERE command IS NOT NULL) WHERE rank <= 6""")
def _(spark, sf):
    return B.scope_git_top(events_as_ev(spark, sf), "project")


CHURN = f"SELECT repo, file_base AS file, count(*) AS edits, count(DISTINCT session_id) AS sessions FROM u WHERE is_edit AND {MAIN} GROUP BY 1, 2"


@query("a25_file_churn", f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY edits DESC, file) AS r FROM ({CHURN}))
SELECT repo, count(*) AS files, sum(edits)::BIGINT AS edits, {ratio4_sql('sum(CASE WHEN r <= 3 THEN edits ELSE 0 END)', 'sum(edits)')} AS top3_share FROM c GROUP BY 1""")
def _(spark, sf):
    return B.file_churn(events_as_ev(spark, sf))


@query("t8_file_churn_top", f"SELECT repo, file, edits, sessions, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY edits DESC, file) AS rank FROM ({CHURN})) WHERE rank <= 8")
def _(spark, sf):
    return B.file_churn_top(events_as_ev(spark, sf))


@query("a26_prompt_signals", f"""
WITH p AS (SELECT conv_id % 7 AS grp, {PROMPT_FLAGS_SQL} FROM (SELECT conv_id, trim(text, E' \\t\\n\\r') AS t FROM conversations WHERE role = 'user') WHERE t <> '')
SELECT grp, {SIGNALS_SQL} FROM p GROUP BY 1""", on_u=False)
def _(spark, sf):
    c = texts(spark, sf, "conversations").filter(F.col("role") == "user").withColumn("grp", F.col("conv_id") % 7)
    return B.prompt_signals(c, "text", "grp")


@query("h8_prompt_flags", f"SELECT doc_id, len, structured, file_ref, constr AS \"constraint\", correction FROM (SELECT doc_id, {PROMPT_FLAGS_SQL} FROM (SELECT doc_id, trim(text, E' \\t\\n\\r') AS t FROM documents) WHERE t <> '')", on_u=False)
def _(spark, sf):
    return B.prompt_flag_rows(texts(spark, sf, "documents"), "text", "doc_id")


@query("a28_session_candidates", f"""
WITH r AS (SELECT session_id, repo FROM (SELECT session_id, repo, row_number() OVER (PARTITION BY session_id ORDER BY file_id, event_id) AS r FROM u WHERE {MAIN}) WHERE r = 1),
p AS (SELECT session_id, {PROMPT_FLAGS_SQL} FROM (SELECT session_id, trim(prompt_text) AS t FROM u WHERE is_boundary)),
s AS (SELECT session_id, {SIGNALS_SQL} FROM p GROUP BY 1),
b AS (SELECT session_id, sum(total)::BIGINT AS tokens, count(*) FILTER (WHERE is_call) AS tool_calls, count(*) FILTER (WHERE is_boundary) AS prompts,
 count(DISTINCT model) AS models, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM u WHERE {MAIN} GROUP BY 1)
SELECT b.*, r.repo, {round_sql('(last_us - first_us)::DOUBLE / 60000000.0::DOUBLE', 1)} AS span_minutes,
 {', '.join(f'coalesce({c}, 0.0::DOUBLE) AS {c}' for c in ('avg_len', 'structured_ratio', 'file_ref_ratio', 'constraint_ratio', 'correction_rate'))}
FROM b JOIN r USING (session_id) LEFT JOIN s USING (session_id)""")
def _(spark, sf):
    return S.session_candidates_a(events_as_ev(spark, sf))


@query("a29_session_candidates", f"""
WITH l AS (SELECT file_id, session_id, repo, model, row_number() OVER (PARTITION BY file_id ORDER BY event_id DESC) AS r FROM u WHERE {MAIN})
SELECT file_id, l.session_id, l.repo, l.model, b.* EXCLUDE (file_id) FROM (
 SELECT file_id, sum(total)::BIGINT AS tokens, count(*) FILTER (WHERE is_boundary) AS prompts, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS duration_seconds,
  count(*) FILTER (WHERE tool_kind = 'shell') AS shell_calls, count(*) FILTER (WHERE tool_kind = 'web') AS web_searches,
  count(*) FILTER (WHERE tool_kind = 'file') AS file_changes, count(*) FILTER (WHERE is_call) AS tool_calls FROM u WHERE {MAIN} GROUP BY 1) b
 JOIN l USING (file_id) WHERE l.r = 1""")
def _(spark, sf):
    return S.session_candidates_b(events_as_ev(spark, sf))


@query("a29_session_top_commands", f"""
SELECT file_id, command, calls, rank FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY calls DESC, command) AS rank FROM (
 SELECT file_id, {first_token_sql('command')} AS command, count(*) AS calls FROM u WHERE tool_kind = 'shell' AND {MAIN} GROUP BY 1, 2)) WHERE rank <= 8""")
def _(spark, sf):
    return S.session_top_commands(events_as_ev(spark, sf))


@query("t6_top_sessions", f"""
SELECT session_id, sum(total)::BIGINT AS tokens, count(*) FILTER (WHERE is_call) AS tool_calls FROM u WHERE {MAIN} GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20""")
def _(spark, sf):
    return K.top_sessions(S.session_candidates_a(events_as_ev(spark, sf)).select("session_id", "tokens", "tool_calls"))


@query("t7_j14_selected_prompts", f"""
WITH top AS (SELECT session_id FROM u WHERE {MAIN} GROUP BY 1 ORDER BY sum(total) DESC, count(*) FILTER (WHERE is_call) DESC, 1 LIMIT 1)
SELECT session_id, event_id, repo FROM u WHERE is_boundary AND session_id IN (SELECT session_id FROM top)""")
def _(spark, sf):
    ev = events_as_ev(spark, sf)
    top = K.top_sessions(S.session_candidates_a(ev).select("session_id", "tokens", "tool_calls"), 1)
    return J.session_prompts(ev, top).select("session_id", F.expr(f"seq div {STRIDE}").alias("event_id"), "repo")


@query("t10_merged_top", f"""
SELECT platform, block, name, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY platform, block ORDER BY n DESC, name) AS rank FROM (
 SELECT platform, 'repo' AS block, repo AS name, sum(total)::BIGINT AS n FROM u GROUP BY 1, 3
 UNION ALL SELECT platform, 'session', session_id, sum(total)::BIGINT FROM u WHERE {MAIN} GROUP BY 1, 3)) WHERE rank <= CASE block WHEN 'session' THEN 5 ELSE 10 END""")
def _(spark, sf):
    ev = events_as_ev(spark, sf).filter(F.col("kind") == "tokens")
    sums = lambda rows, key: rows.groupBy("platform", F.col(key).alias("name")).agg(F.sum("total").alias("n"))
    repos = K.top_per_group(sums(ev, "repo"), 10, ["platform"], "n", "name").withColumn("block", F.lit("repo"))
    sessions = K.top_per_group(sums(ev.filter(~F.col("is_sidechain")), "session_id"), 5, ["platform"], "n", "name").withColumn("block", F.lit("session"))
    return repos.unionByName(sessions)


@query("a30_project_facts", """
WITH f AS (SELECT repo, bool_or(file_base = 'file1.py') AS t, bool_or(command = 'make') AS b, bool_or(k % 50 = 7) AS c FROM u GROUP BY 1)
SELECT count(*) AS repos, count(*) FILTER (WHERE t) AS repos_with_tests, count(*) FILTER (WHERE b) AS repos_with_build_system, count(*) FILTER (WHERE c) AS repos_with_ci FROM f""")
def _(spark, sf):
    u = events_wide(spark, sf)
    return B.project_facts(u.select(
        "repo", (F.col("file_base") == "file1.py").alias("has_tests"), (F.col("command") == "make").alias("has_build"),
        (F.col("k") % 50 == 7).alias("has_ci")))


@query("a41_platform_profile", f"""
WITH b AS (
 SELECT platform, 'command' AS block, {first_token_sql('command')} AS name, 12 AS lim FROM u WHERE tool_kind = 'shell' AND {MAIN}
 UNION ALL SELECT platform, 'git', {git_sql('command')}, 10 FROM u WHERE tool_kind = 'shell' AND {MAIN}
 UNION ALL SELECT platform, 'tool_kind', tool_kind, 1000 FROM u WHERE {CALLS}
 UNION ALL SELECT platform, 'tool_name', tool_name, 15 FROM u WHERE {CALLS}
 UNION ALL SELECT platform, 'mcp', split_part(tool_name, '__', 2), 1000 FROM u WHERE {CALLS} AND starts_with(tool_name, 'mcp__')
 UNION ALL SELECT platform, 'language', {LANG.format('file_ext')}, 10 FROM u WHERE tool_kind = 'file' AND {MAIN}
 UNION ALL SELECT platform, 'skill', CASE WHEN contains(label, ':') THEN string_split(label, ':')[2] ELSE label END, 12 FROM u WHERE label_field = 'skill'
 UNION ALL SELECT platform, 'permission_mode', label, 4 FROM u WHERE label_field = 'permission_mode'
 UNION ALL SELECT platform, 'subagent', 'messages', 1000 FROM u WHERE marker = 'subagent'
 UNION ALL SELECT platform, 'hour', CAST(hour(ts) AS VARCHAR), 1000 FROM u),
fs AS (SELECT platform, session_id, first(source ORDER BY file_id, event_id) AS source FROM u WHERE source <> '' GROUP BY 1, 2),
us AS (SELECT DISTINCT platform, session_id FROM u WHERE {MAIN}),
c AS (SELECT platform, block, name, lim, count(*) AS n FROM b WHERE name IS NOT NULL GROUP BY 1, 2, 3, 4
 UNION ALL SELECT platform, 'repo', repo, 10, sum(total)::BIGINT FROM u GROUP BY 1, 3
 UNION ALL SELECT platform, 'source', source, 1000, count(*) FROM fs JOIN us USING (platform, session_id) GROUP BY 1, 3)
SELECT platform, block, name, n FROM (SELECT *, row_number() OVER (PARTITION BY platform, block ORDER BY n DESC, name) AS r FROM c) WHERE r <= lim""")
def _(spark, sf):
    return CO.platform_profile(events_as_ev(spark, sf))


@query("a42_top_sessions", f"""
WITH p AS (SELECT platform, session_id, repo, sum(total) AS t FROM u WHERE {MAIN} GROUP BY 1, 2, 3),
tr AS (SELECT platform, session_id, first(repo ORDER BY t DESC, repo) AS repo FROM p GROUP BY 1, 2),
s AS (SELECT platform, session_id, sum(total)::BIGINT AS tokens, count(*) FILTER (WHERE is_call) AS tool_calls, epoch_us(min(ts)) AS first_ts, epoch_us(max(ts)) AS last_ts FROM u WHERE {MAIN} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY tokens DESC, tool_calls DESC, session_id) AS place FROM s JOIN tr USING (platform, session_id) WHERE tokens > 0)
SELECT * FROM r WHERE place <= 10""")
def _(spark, sf):
    return CO.platform_top_sessions(events_as_ev(spark, sf))


SUMMARY_SQL = f"""SELECT platform, sum(nano)::DOUBLE / 1e9::DOUBLE AS cost_usd, count(DISTINCT CASE WHEN {MAIN} THEN session_id END) AS sessions, count(DISTINCT CAST(ts AS DATE)) AS active_days,
 strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, sum(fresh)::BIGINT AS fresh,
 sum(CASE WHEN claude THEN cached_input ELSE least(cached_input, input) END)::BIGINT AS cache_read, sum(CASE WHEN claude THEN cache_creation ELSE 0 END)::BIGINT AS cache_write,
 sum(output)::BIGINT AS output, sum(total)::BIGINT AS total, {ratio_sql('sum(cached_input)', 'sum(cached_input) + sum(fresh)')} AS cache_hit_rate FROM u GROUP BY 1"""


@query("a42_platform_summary", SUMMARY_SQL)
def _(spark, sf):
    return CO.platform_summary(events_as_ev(spark, sf))


@query("a43_compare_platforms", f"""
WITH s AS ({SUMMARY_SQL}),
m AS (SELECT platform, unnest(['sessions', 'active_days', 'fresh', 'cache_read', 'output', 'total', 'cost_usd']) AS metric,
 unnest([sessions::DOUBLE, active_days::DOUBLE, fresh::DOUBLE, cache_read::DOUBLE, output::DOUBLE, total::DOUBLE, cost_usd]) AS value FROM s),
w AS (SELECT metric, sum(value) FILTER (WHERE platform = 'A') AS a, sum(value) FILTER (WHERE platform = 'B') AS b FROM m GROUP BY 1)
SELECT metric, a, b, CASE WHEN a + b > 0 THEN a / (a + b) * 100.0::DOUBLE ELSE 0.0::DOUBLE END AS a_share FROM w""")
def _(spark, sf):
    return CO.compare_platforms(CO.platform_summary(events_as_ev(spark, sf)))


@query("h24_tier_scores", f"""
WITH p AS (SELECT session_id, {PROMPT_FLAGS_SQL} FROM (SELECT session_id, trim(prompt_text) AS t FROM u WHERE is_boundary)),
s AS (SELECT session_id, {SIGNALS_SQL} FROM p GROUP BY 1),
b AS (SELECT session_id, sum(total) AS tokens, sum(nano)::DOUBLE / 1e9::DOUBLE AS cost, count(DISTINCT file_id) AS sessions, count(DISTINCT CAST(ts AS DATE)) AS days,
 count(DISTINCT repo) AS repos, {ratio_sql("sum(CASE WHEN contains(model_norm, 'opus') THEN nano ELSE 0 END)", 'sum(nano)')} AS premium,
 count(*) FILTER (WHERE {CALLS} AND tool_kind = 'file') AS files, count(*) FILTER (WHERE {CALLS} AND tool_kind IN ('shell', 'web', 'search')) AS loop,
 {ratio_sql('count(*) FILTER (WHERE hour(ts) >= 22 OR hour(ts) <= 5)', 'count(*)')} AS late FROM u GROUP BY 1),
q AS (SELECT b.*, coalesce(prompts, 0) AS prompts, 0.30::DOUBLE * coalesce(structured_ratio, 0) + 0.25::DOUBLE * coalesce(constraint_ratio, 0) + 0.20::DOUBLE * coalesce(file_ref_ratio, 0)
  + 0.25::DOUBLE * (1.0::DOUBLE - coalesce(correction_rate, 0)) - CASE WHEN coalesce(avg_len, 0) > 1500 OR coalesce(avg_len, 0) < 12 THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END AS q FROM b LEFT JOIN s USING (session_id))
SELECT session_id, CASE WHEN prompts = 0 THEN 2 WHEN q >= 0.62::DOUBLE THEN 0 WHEN q >= 0.45::DOUBLE THEN 1 WHEN q >= 0.30::DOUBLE THEN 2 WHEN q >= 0.16::DOUBLE THEN 3 ELSE 4 END AS prompt_tier,
 CASE WHEN premium >= 0.6::DOUBLE AND tokens::DOUBLE / sessions::DOUBLE < 8000 THEN 3 WHEN cost >= 30 THEN 2 WHEN cost >= 5 THEN 1 ELSE 0 END AS spending_tier,
 CASE WHEN repos::DOUBLE / sessions::DOUBLE >= 2.0::DOUBLE OR (repos >= 4 AND sessions <= 2) THEN 3 WHEN loop::DOUBLE / (files + 1)::DOUBLE >= 4 THEN 2
  WHEN loop::DOUBLE / (files + 1)::DOUBLE >= 1.5::DOUBLE THEN 1 ELSE 0 END AS engineering_tier,
 CASE WHEN days <= 1 AND sessions <= 2 THEN 3 WHEN late >= 0.35::DOUBLE THEN 1 WHEN days >= 5 THEN 0 ELSE 2 END AS diligence_tier FROM q""")
def _(spark, sf):
    from ..functions.models import is_disjoint  # noqa: F401
    from ..functions.numbers import count_true, ratio
    from ..operators.score import tier_scores
    ev = events_as_ev(spark, sf)
    return tier_scores(user_totals(ev), "session_id")


def user_totals(ev):
    """Aggregates per user (here: per session owner) that the tier scores read; every log file counts as a session."""
    from ..functions.numbers import count_true
    used, hour = F.col("total").isNotNull(), F.hour("ts")
    base = ev.groupBy("session_id").agg(
        F.sum("total").alias("tokens"), F.count_distinct("file_id").alias("sessions"), F.count_distinct(F.to_date("ts")).alias("active_days"),
        F.count_distinct("repo").alias("repos"), count_true(used).alias("hour_events"),
        count_true(used & ((hour >= 22) | (hour <= 5))).alias("late_events"))
    cost = U.estimate_cost(ev, "session_id").select("session_id", "cost_usd")
    share = U.model_class_cost_share(ev, "opus", "session_id").select("session_id", F.col("cost_share").alias("premium_share"))
    calls = B.tool_calls(ev).groupBy("session_id").agg(*[
        F.count(F.when(F.col("tool_kind") == k, F.lit(1))).alias(f"{k}_calls") for k in ("shell", "web", "file", "search")])
    signals = B.ev_prompt_signals(ev, "session_id")
    out = base
    for part in (cost, share, calls, signals):
        out = out.join(part, "session_id", "left")
    return out.fillna(0)
