"""Scalar expressions evaluated over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models as M, numbers as N, prompts as P, text as X, timez as Z
from . import corpus as C
from .adapters import events_wide, pick, table, texts
from .registry import (BASE, CORRECTION_SQL, ERROR_SQL, HUMAN_SQL, LONG_RUN_SQL, THINKING_SQL, first_token_sql, git_sql, query,
                       sql_list)


def _ids(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id")


@query("h1_first_token", f"SELECT event_id, {first_token_sql('command')} AS token FROM (SELECT event_id, {sql_list(C.COMMANDS, 'event_id')} AS command FROM events)", on_u=False)
def _(spark, sf):
    return _ids(spark, sf).select("event_id", X.first_token(pick(C.COMMANDS, F.col("event_id"))).alias("token"))


@query("h2_git_subcommand", f"SELECT event_id, {git_sql('command')} AS sub FROM (SELECT event_id, {sql_list(C.COMMANDS, 'event_id')} AS command FROM events)", on_u=False)
def _(spark, sf):
    return _ids(spark, sf).select("event_id", X.git_subcommand(pick(C.COMMANDS, F.col("event_id"))).alias("sub"))


@query("h3_path_parts", f"""
SELECT page_id, {BASE.format('url')} AS base, CASE WHEN contains({BASE.format('url')}, '.') THEN lower(list_extract(string_split({BASE.format('url')}, '.'), -1)) ELSE '' END AS ext FROM pages""", on_u=False)
def _(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", X.base_name(url).alias("base"), X.ext_of(url).alias("ext"))


@query("h4_repo_name", rf"SELECT page_id, CASE WHEN b = '' THEN '(unknown)' ELSE b END AS repo FROM (SELECT page_id, {BASE.format(chr(39).join(['regexp_replace(url || ', '//', ', ', '[/\\\\]+$', ', ', '', ')']))} AS b FROM pages)", on_u=False)
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.repo_name(F.concat("url", F.lit("//"))).alias("repo"))


@query("h5_h6_model_names", "SELECT event_id, model_norm AS name, starts_with(model_norm, 'claude') AS disjoint FROM u")
def _(spark, sf):
    m = F.col("model")
    return events_wide(spark, sf).select("event_id", M.normalize_model(m).alias("name"), M.is_disjoint(m).alias("disjoint"))


@query("h7_classify_error", f"SELECT doc_id, {ERROR_SQL.format('text')} AS category FROM documents", on_u=False)
def _(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", X.classify_error(F.col("text")).alias("category"))


@query("h7_classify_error_lines", f"SELECT event_id, {ERROR_SQL.format('t')} AS category FROM (SELECT event_id, {sql_list(C.ERRORS, 'event_id')} AS t FROM events)", on_u=False)
def _(spark, sf):
    return _ids(spark, sf).select("event_id", X.classify_error(pick(C.ERRORS, F.col("event_id"))).alias("category"))


@query("h9_text_flags", f"SELECT doc_id, {CORRECTION_SQL.format('text')} AS correction, {LONG_RUN_SQL.format('text')} AS long_run, {THINKING_SQL.format('text')} AS thinking FROM documents", on_u=False)
def _(spark, sf):
    t = F.col("text")
    return texts(spark, sf, "documents").select(
        "doc_id", P.is_correction(t).alias("correction"), P.is_long_run(t).alias("long_run"), P.is_thinking(t).alias("thinking"))


@query("h9_text_flags_lines", f"""
SELECT event_id, {CORRECTION_SQL.format('p')} AS correction, {LONG_RUN_SQL.format('c')} AS long_run, {THINKING_SQL.format('p')} AS thinking
FROM (SELECT event_id, {sql_list(C.PROMPTS, 'event_id')} AS p, {sql_list(C.COMMANDS, 'event_id')} AS c FROM events)""", on_u=False)
def _(spark, sf):
    p, c = pick(C.PROMPTS, F.col("event_id")), pick(C.COMMANDS, F.col("event_id"))
    return _ids(spark, sf).select("event_id", P.is_correction(p).alias("correction"), P.is_long_run(c).alias("long_run"), P.is_thinking(p).alias("thinking"))


@query("f4_human_prompts", f"""
SELECT conv_id, turn FROM conversations WHERE role = 'user' AND {HUMAN_SQL.format('text')} AND turn % 5 <> 4""", on_u=False)
def _(spark, sf):
    c = texts(spark, sf, "conversations").filter(F.col("role") == "user")
    return c.filter(P.is_human_prompt(F.col("text"), F.col("turn") % 5 == 4)).select("conv_id", "turn")


@query("f4_human_prompt_lines", f"SELECT event_id FROM (SELECT event_id, {sql_list(C.PROMPTS, 'event_id')} AS t FROM events) WHERE {HUMAN_SQL.format('t')}", on_u=False)
def _(spark, sf):
    rows = _ids(spark, sf).withColumn("t", pick(C.PROMPTS, F.col("event_id")))
    return rows.filter(P.is_human_prompt(F.col("t"), F.lit(False))).select("event_id")


@query("h11_mcp_parts", """
SELECT event_id, CASE WHEN starts_with(tool_name, 'mcp__') THEN string_split(substr(tool_name, 6), '__')[1] END AS server,
 CASE WHEN starts_with(tool_name, 'mcp__') THEN coalesce(string_split(substr(tool_name, 6), '__')[2], '') END AS tool FROM u WHERE tool_name IS NOT NULL""")
def _(spark, sf):
    n = F.col("tool_name")
    return events_wide(spark, sf).filter(n.isNotNull()).select("event_id", X.mcp_server(n).alias("server"), X.mcp_tool(n).alias("tool"))


@query("h12_source_key", f"""
SELECT event_id, CASE WHEN s = '' THEN '(unknown)' WHEN contains(s, 'vscode') OR contains(s, 'ide') THEN 'plugin'
 WHEN contains(s, 'codex-app') OR contains(s, 'desktop') OR s = 'app' THEN 'codex-app' WHEN contains(s, 'cli') OR contains(s, 'terminal') THEN 'cli' ELSE s END AS source
FROM (SELECT event_id, lower(trim({sql_list(C.RAW_SOURCES, 'event_id')})) AS s FROM events)""", on_u=False)
def _(spark, sf):
    return _ids(spark, sf).select("event_id", X.source_key(pick(C.RAW_SOURCES, F.col("event_id"))).alias("source"))


@query("h13_repo_key", r"""
SELECT page_id, CASE WHEN u = '' THEN 'dir' || page_id % 5 WHEN l = '' THEN '(unknown)' ELSE l END AS repo FROM (
 SELECT page_id, u, list_extract(string_split_regex(u, '[/ :]'), -1) AS l FROM (
  SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '' ELSE regexp_replace(regexp_replace(url || '.git/', '/+$', ''), '\.git$', '') END AS u FROM pages))""", on_u=False)
def _(spark, sf):
    origin = F.when(F.col("page_id") % 4 == 0, F.lit("")).otherwise(F.concat("url", F.lit(".git/")))
    cwd = F.concat(F.lit("/home/u/dir"), F.col("page_id") % 5)
    return table(spark, sf, "pages").select("page_id", X.repo_key(origin, cwd).alias("repo"))


# The commands these argument texts hold, with shell starters removed.
@query("h14_command_from_args", f"SELECT event_id, {sql_list(['git status', 'git push', 'ls -l', '', '', '', 'pytest'], 'event_id')} AS command FROM events", on_u=False)
def _(spark, sf):
    return _ids(spark, sf).select("event_id", X.unwrap_shell(X.command_from_args(pick(C.SHELL_ARGS, F.col("event_id")))).alias("command"))


@query("h15_output_outcome", f"""
SELECT event_id, {sql_list(['0', '128', '2', '', '', '', ''], 'event_id')} AS exit_code, {sql_list(['ok', 'fatal: bad', 'x', 'plain text', C.OUTPUTS[4], C.OUTPUTS[5], C.OUTPUTS[6]], 'event_id')} AS text,
 event_id % 7 IN (2, 4) AS interrupted FROM events""", on_u=False)
def _(spark, sf):
    from ..sources.normalize_b import output_outcome
    code, text, interrupted = output_outcome(pick(C.OUTPUTS, F.col("event_id")))
    return _ids(spark, sf).select("event_id", F.coalesce(code.cast("string"), F.lit("")).alias("exit_code"), text.alias("text"), interrupted.alias("interrupted"))


@query("h16_diff_lines", f"SELECT event_id, CAST({sql_list(['2', '0', '1', '0'], 'event_id')} AS BIGINT) AS added, CAST({sql_list(['1', '0', '1', '0'], 'event_id')} AS BIGINT) AS removed FROM events", on_u=False)
def _(spark, sf):
    d = pick(C.DIFFS, F.col("event_id"))
    return _ids(spark, sf).select("event_id", X.diff_added(d).alias("added"), X.diff_removed(d).alias("removed"))


@query("h19_local_fields", """
SELECT event_id, strftime(ts - INTERVAL '3 hours', '%Y-%m-%d') AS day, hour(ts - INTERVAL '3 hours') AS hour, strftime(ts - INTERVAL '3 hours' + INTERVAL '10 days', '%Y-%m-%d') AS later FROM events""", on_u=False)
def _(spark, sf):
    ts, tz = F.col("ts"), "America/Sao_Paulo"
    return table(spark, sf, "events").select(
        "event_id", Z.day_text(ts, tz).alias("day"), Z.local_hour(ts, tz).alias("hour"), F.date_add(Z.local_day(ts, tz), 10).alias("later"))


@query("h20_language_of", """
SELECT event_id, CASE ext0 WHEN 'py' THEN 'Python' WHEN 'ts' THEN 'TypeScript' WHEN 'md' THEN 'Markdown' WHEN 'sql' THEN 'SQL' END AS language FROM u""")
def _(spark, sf):
    return events_wide(spark, sf).select("event_id", X.language_of(F.upper("ext0")).alias("language"))


@query("h21_url_host", r"""
SELECT page_id, h AS host, CASE WHEN h = '' THEN 'unknown' WHEN h IN ('api.anthropic.com', 'api.openai.com', 'chatgpt.com') THEN 'official' ELSE 'custom' END AS endpoint FROM (
 SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'api.openai.com' WHEN 2 THEN '' ELSE lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) END AS h FROM pages)""", on_u=False)
def _(spark, sf):
    url = F.when(F.col("page_id") % 4 == 1, F.lit("API.OpenAI.com/v1")).when(F.col("page_id") % 4 == 2, F.lit(" ")).otherwise(F.col("url"))
    host = X.url_host(url)
    return table(spark, sf, "pages").select("page_id", host.alias("host"), X.host_class(host).alias("endpoint"))


@query("h25_cost_with_nullable_write", """
SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN input * 5000 + cached_input * 500 + cache_creation * 6250 + output * 25000
 ELSE (input - least(cached_input, input)) * 1250 + least(cached_input, input) * 125 + output * 10000 END)::DOUBLE / 1e9::DOUBLE AS cost_usd FROM u""")
def _(spark, sf):
    even = F.col("event_id") % 2 == 0
    rate = lambda a, b: F.when(even, F.lit(a)).otherwise(F.lit(b)).cast("bigint")
    price = F.struct(F.lit("p").alias("prefix"), rate(5000, 1250).alias("input"), rate(500, 125).alias("cached_input"),
                     rate(25000, 10000).alias("output"), F.when(even, F.lit(6250).cast("bigint")).alias("cache_creation"))
    rows = events_wide(spark, sf).withColumn("p", price)
    nano = M.cost_nano(F.col("p"), *[F.col(c) for c in ("input", "cached_input", "cache_creation", "output")],
                       M.uncached_input(F.col("input"), F.col("cached_input")))
    return rows.select("event_id", M.nano_to_usd(nano).alias("cost_usd"))


@query("h26_tool_kind", "SELECT event_id, tool_kind FROM u WHERE is_call")
def _(spark, sf):
    u = events_wide(spark, sf).filter(F.col("event_type").isin("view", "click", "purchase"))
    return u.select("event_id", X.tool_kind(F.col("tool_name")).alias("tool_kind"))


@query("h27_skill_split", """
SELECT event_id, CASE WHEN contains(label, ':') THEN string_split(label, ':')[1] END AS plugin, CASE WHEN contains(label, ':') THEN string_split(label, ':')[2] ELSE label END AS short
FROM u WHERE label_field = 'skill'""")
def _(spark, sf):
    s = F.col("label")
    return events_wide(spark, sf).filter(F.col("label_field") == "skill").select("event_id", X.plugin_of(s).alias("plugin"), X.skill_short(s).alias("short"))


@query("h28_percent_share", "SELECT repo, sum(total)::BIGINT::DOUBLE / (SELECT sum(total)::BIGINT FROM u)::DOUBLE * 100.0::DOUBLE AS share FROM u GROUP BY 1")
def _(spark, sf):
    per = events_wide(spark, sf).groupBy("repo").agg(F.sum("total").alias("t"))
    return per.select("repo", N.percent_share(F.col("t"), per.agg(F.sum("t")).scalar()).alias("share"))
