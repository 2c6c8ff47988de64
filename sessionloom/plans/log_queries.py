"""Log reading, parsing and normalizing over JSON lines that Spark derives from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.scan import CHUNK_WIDTH
from ..operators import content as D
from ..session import new_path, stage
from ..sources import logs as L, normalize_a as NA, normalize_b as NB, sinks
from ..sources.commits import parse_commits
from ..operators.usage import by_repo
from . import corpus as C
from .adapters import events_as_ev, events_dealt, pick, plan_cache, table
from .registry import ERROR_SQL, HUMAN_SQL, first_token_sql, query, sql_list


def _iso(ts):
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


@plan_cache
def raw_lines_a(spark, sf) -> DataFrame:
    """One platform A log line per event; every 41st ``k`` is cut off in the middle."""
    u = events_dealt(spark, sf)
    et, k = F.col("event_type"), F.col("k")
    is_user = et.isin("signup", "error")
    head = [
        F.when(is_user, F.lit("user")).otherwise(F.lit("assistant")).alias("type"), _iso(F.col("ts")).alias("timestamp"),
        F.col("session_id").alias("sessionId"), F.concat(F.lit("u"), "event_id").alias("uuid"), F.lit("r").alias("requestId"),
        F.concat(F.lit("/home/u/"), "repo").alias("cwd"), F.col("branch").alias("gitBranch"), F.col("is_sidechain").alias("isSidechain"),
        F.col("source").alias("entrypoint")]
    usage = F.when(~is_user, F.struct(F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"),
                                      F.col("cached_input").alias("cache_read_input_tokens"), k.alias("cache_creation_input_tokens")))
    call = F.concat(F.lit("t"), k % 50)
    block = F.struct(
        F.when(et == "signup", F.lit("text")).when(et == "error", F.lit("tool_result")).otherwise(F.lit("tool_use")).alias("type"),
        F.when(et == "signup", F.col("prompt_text")).alias("text"), F.when(~is_user, call).alias("id"), F.when(~is_user, F.col("tool_name")).alias("name"),
        F.when(~is_user, F.struct(F.col("command"), F.concat(F.lit("/src/x/"), "file_base").alias("file_path"))).alias("input"),
        F.when(et == "error", call).alias("tool_use_id"), F.when(et == "error", F.col("is_error")).alias("is_error"), F.when(et == "error", F.col("error_text")).alias("content"))
    mid = F.when(~is_user, F.concat(F.lit("m"), "user_id", F.lit("-"), F.expr("event_id div 2"))).alias("id")
    model = F.when(~is_user, F.col("model")).alias("model")
    stop = F.when(et == "error", F.struct((k % 9 == 1).alias("interrupted"))).alias("toolUseResult")
    plain = F.to_json(F.struct(*head, F.struct(mid, F.col("prompt_text").alias("content")).alias("message")))
    blocks = F.to_json(F.struct(*head, F.struct(mid, model, F.array(block).alias("content"), usage.alias("usage")).alias("message"), stop))
    value = F.when((et == "signup") & (k % 2 == 0), plain).otherwise(blocks)
    lines = u.select("file_id", F.col("event_id").alias("line_no"), F.when(k % 41 == 5, F.substring(value, 1, 20)).otherwise(value).alias("value"))
    return stage(lines, "lines-a")


@plan_cache
def normalized_a(spark, sf) -> DataFrame:
    good, _ = L.parse_json(raw_lines_a(spark, sf))
    return sinks.land_ev(NA.normalize_a(good), new_path(spark, "ev-a"), by_day=False)


@plan_cache
def raw_lines_b(spark, sf) -> DataFrame:
    """One platform B log line per event plus a header line per file; every ninth user's files are sub-agent files."""
    u = events_dealt(spark, sf)
    et, k = F.col("event_type"), F.col("k")
    base = F.col("file_base")
    diff = pick(C.DIFFS, k)
    record = lambda kind, payload: F.to_json(F.struct(F.lit(kind).alias("type"), _iso(F.col("ts")).alias("timestamp"), payload.alias("payload")))
    usage = F.struct(F.col("input").alias("input_tokens"), F.col("cached_input").alias("cached_input_tokens"), F.col("output").alias("output_tokens"),
                     (F.col("input") + F.col("output")).alias("total_tokens"))
    tokens = F.struct(F.lit("token_count").alias("type"), F.struct(usage.alias("last_token_usage")).alias("info"))
    turn = F.struct("model", pick(C.LABELS["effort"], k).alias("effort"))
    call = F.struct(F.lit("function_call").alias("type"), F.lit("shell").alias("name"), F.concat(F.lit("c"), "event_id").alias("call_id"), pick(C.SHELL_ARGS, k).alias("arguments"))
    output = F.struct(F.lit("function_call_output").alias("type"), F.concat(F.lit("c"), "event_id").alias("call_id"), pick(C.OUTPUTS, k).alias("output"))
    patch = F.struct(F.lit("patch_apply_end").alias("type"), F.create_map(F.concat(F.lit("/p/"), base), F.struct(diff.alias("unified_diff"))).alias("changes"))
    value = (F.when(et == "view", record("event_msg", tokens)).when(et == "signup", record("turn_context", turn)).when(et == "click", record("response_item", call))
             .when(et == "error", record("response_item", output)).otherwise(record("event_msg", patch)))
    body = u.select("file_id", (F.col("event_id") + 1).alias("line_no"), value.alias("value"))
    first = u.groupBy("file_id", "session_id", "user_id").agg(F.min("ts").alias("ts"))
    source = F.when(F.col("user_id") % 9 == 4, F.lit("subagent-x")).otherwise(F.lit("vscode"))
    header = first.select("file_id", F.lit(0).cast("bigint").alias("line_no"), record("session_meta", F.struct(
        F.col("session_id").alias("id"), F.concat(F.lit("/w/subagent"), F.col("user_id") % 3).alias("cwd"), source.alias("source"),
        F.when(F.col("user_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("git@host:team/proj"), F.col("user_id") % 4, F.lit(".git/"))).alias("git_origin_url"),
        F.when(F.col("user_id") % 4 != 1, F.concat(F.lit("b"), F.col("user_id") % 5)).alias("git_branch"))).alias("value"))
    return stage(header.unionByName(body), "lines-b")


@plan_cache
def normalized_b(spark, sf) -> DataFrame:
    good, _ = L.parse_json(raw_lines_b(spark, sf))
    return sinks.land_ev(NB.normalize_b(good), new_path(spark, "ev-b"), by_day=False)


def _write_lines(spark, sf, raw: DataFrame, prefix: str) -> str:
    """Write the lines as one folder per log file; position order inside a file is kept by the sort."""
    path = new_path(spark, "lines")
    rows = raw.withColumn("log", F.concat(F.lit(prefix), F.xxhash64("file_id") % 8))
    rows.repartition("log", F.expr(f"line_no div {CHUNK_WIDTH}")).sortWithinPartitions("log", "file_id", "line_no").select("log", "value").write.partitionBy("log").text(path)
    return path


@query("a29_session_facts", """
WITH m AS (SELECT file_id, first(model ORDER BY event_id DESC) AS model FROM u WHERE event_type = 'signup' GROUP BY 1)
SELECT DISTINCT u.file_id, session_id, CASE WHEN user_id % 3 = 0 THEN 'subagent' || (user_id % 3) ELSE 'proj' || (user_id % 4) END AS repo, 'plugin' AS source,
 CASE WHEN user_id % 4 <> 1 THEN 'b' || (user_id % 5) ELSE '' END AS branch, coalesce(m.model, '') AS model FROM u LEFT JOIN m USING (file_id) WHERE user_id % 9 <> 4""")
def _(spark, sf):
    return NB.session_facts(L.parse_json(raw_lines_b(spark, sf))[0])


@query("a29_candidates_from_lines", """
WITH f AS (SELECT file_id, user_id, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS tool_calls, count(*) FILTER (WHERE event_type = 'click') AS shell_calls,
  count(*) FILTER (WHERE event_type = 'purchase') AS file_changes, coalesce(sum(input + output) FILTER (WHERE event_type = 'view'), 0)::BIGINT AS tokens FROM u WHERE user_id % 9 <> 4 GROUP BY 1, 2)
SELECT file_id, CASE WHEN user_id % 3 = 0 THEN 'subagent' || (user_id % 3) ELSE 'proj' || (user_id % 4) END AS repo, 'plugin' AS source,
 CASE WHEN user_id % 4 <> 1 THEN 'b' || (user_id % 5) ELSE '' END AS branch, tokens, tool_calls, shell_calls, file_changes FROM f WHERE tokens <> 0 OR tool_calls <> 0""")
def _(spark, sf):
    from ..operators.sessions import session_candidates_b
    facts = NB.session_facts(L.parse_json(raw_lines_b(spark, sf))[0])
    found = session_candidates_b(normalized_b(spark, sf), facts)
    return found.select("file_id", "repo", "source", "branch", "tokens", "tool_calls", "shell_calls", "file_changes")


@query("s1_s3_read_logs", "SELECT count(*) AS lines, count(*) AS distinct_positions FROM events", on_u=False)
def _(spark, sf):
    path = _write_lines(spark, sf, raw_lines_a(spark, sf), "a")
    raw = L.with_line_no(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path))
    return raw.agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("file_id", "line_no").alias("distinct_positions"))


@query("s4_parse_json", "SELECT count(*) FILTER (WHERE k % 41 <> 5) AS good, count(*) FILTER (WHERE k % 41 = 5) AS bad FROM u")
def _(spark, sf):
    good, bad = L.parse_json(raw_lines_a(spark, sf))
    both = good.select(F.lit(1).alias("g")).unionByName(bad.select(F.lit(0).alias("g")))
    return both.agg(F.coalesce(F.sum("g"), F.lit(0)).alias("good"), F.sum(1 - F.col("g")).alias("bad"))


# Kept records of the derived logs: the first copy of each message, with the largest usage of its copies.
KEPT = """
r AS (SELECT *, CASE WHEN event_type IN ('signup', 'error') THEN 'u' || event_id ELSE 'm' || user_id || '-' || event_id // 2 END AS dk,
  input + output + cached_input + k AS tot FROM u WHERE k % 41 <> 5),
kept AS (SELECT * REPLACE (CASE WHEN is_call THEN max(tot) OVER (PARTITION BY dk) END AS tot), row_number() OVER (PARTITION BY dk ORDER BY file_id, event_id) AS rn FROM r),
x AS (SELECT * FROM kept WHERE rn = 1)"""


@query("s5_normalize_a", f"""WITH {KEPT}
SELECT 'tokens' AS kind, '' AS detail, count(*) AS n, sum(tot)::BIGINT AS total FROM x WHERE is_call
UNION ALL SELECT 'tool_call', tool_kind, count(*), 0 FROM x WHERE is_call AND NOT is_sidechain GROUP BY 2
UNION ALL SELECT 'tool_result', coalesce(error_category, ''), count(*), 0 FROM x WHERE is_result AND NOT is_sidechain GROUP BY 2
UNION ALL SELECT 'prompt', '', count(*), 0 FROM x WHERE is_boundary
UNION ALL SELECT 'touch', '', count(*), 0 FROM x WHERE NOT is_call AND NOT is_sidechain AND NOT is_boundary
UNION ALL SELECT 'interrupt', '', count(*), 0 FROM x WHERE is_result AND k % 9 = 1 AND NOT is_sidechain
UNION ALL SELECT 'subagent', '', count(*), 0 FROM x WHERE is_sidechain""")
def _(spark, sf):
    ev = normalized_a(spark, sf)
    kind = F.col("kind")
    detail = F.when(kind == "tool_call", F.col("tool_kind")).when(kind == "tool_result", F.col("error_category"))
    return ev.groupBy("kind", F.coalesce(detail, F.lit("")).alias("detail")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))


@query("s7_explode_blocks", "SELECT tool_name AS name, count(*) AS n FROM u WHERE is_call AND k % 41 <> 5 GROUP BY 1")
def _(spark, sf):
    good, _ = L.parse_json(raw_lines_a(spark, sf))
    blocks = NA.explode_blocks(NA.project_records(good).filter(F.col("type") == "assistant"))
    return blocks.groupBy(L.text_at(F.col("block"), "$.name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


SUB = "user_id % 9 = 4"


@query("s6_normalize_b", f"""
WITH y AS (SELECT *, CAST({sql_list(['0', '1', '1', '0', '0', '0', '0'], 'k')} AS INT) = 1 AS failed, k % 7 IN (2, 4) AS stopped FROM u)
SELECT 'tokens' AS kind, '' AS detail, count(*) AS n, sum(input + output)::BIGINT AS total FROM y WHERE event_type = 'view' AND input + output > 0
UNION ALL SELECT 'subagent', '', count(*), 0 FROM y WHERE event_type = 'view' AND {SUB} AND input + output > 0
UNION ALL SELECT 'turn', '', count(*), 0 FROM y WHERE event_type = 'signup' AND NOT {SUB}
UNION ALL SELECT 'label', 'effort', count(*), 0 FROM y WHERE event_type = 'signup' AND NOT {SUB}
UNION ALL SELECT 'edit', '', count(*), 0 FROM y WHERE event_type = 'purchase' AND NOT {SUB}
UNION ALL SELECT 'tool_call', CASE event_type WHEN 'click' THEN 'shell' ELSE 'file' END, count(*), 0 FROM y WHERE event_type IN ('click', 'purchase') AND NOT {SUB} GROUP BY 2
UNION ALL SELECT 'tool_result', CASE WHEN k % 7 = 1 THEN 'git' WHEN k % 7 = 2 THEN 'other' ELSE '' END, count(*), 0 FROM y WHERE event_type = 'error' AND NOT {SUB} GROUP BY 2
UNION ALL SELECT 'interrupt', '', count(*), 0 FROM y WHERE event_type = 'error' AND stopped AND NOT {SUB}""")
def _(spark, sf):
    ev = normalized_b(spark, sf)
    kind = F.col("kind")
    detail = (F.when(kind == "tool_call", F.col("tool_kind")).when(kind == "tool_result", F.col("error_category")).when(kind == "label", F.col("label_field")))
    return ev.groupBy("kind", F.coalesce(detail, F.lit("")).alias("detail")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))


@query("f6_subagent_files", f"SELECT DISTINCT file_id, {SUB} AS is_sidechain FROM u")
def _(spark, sf):
    from ..operators.joins import flag_subagent_files
    good, _ = L.parse_json(raw_lines_b(spark, sf))
    return flag_subagent_files(NB.project_records(good))


@query("s8_explode_changes", f"""
SELECT file_base, sum(CAST({sql_list(['2', '0', '1', '0'], 'k')} AS BIGINT))::BIGINT AS lines_added, sum(CAST({sql_list(['1', '0', '1', '0'], 'k')} AS BIGINT))::BIGINT AS lines_removed
FROM u WHERE event_type = 'purchase' GROUP BY 1""")
def _(spark, sf):
    good, _ = L.parse_json(raw_lines_b(spark, sf))
    rows = NB.explode_changes(NB.project_records(good).filter(F.col("ptype") == "patch_apply_end"))
    return rows.groupBy("file_base").agg(F.sum("lines_added").alias("lines_added"), F.sum("lines_removed").alias("lines_removed"))


@query("d3_digest_items_a", """
WITH x AS (SELECT * FROM u WHERE k % 41 <> 5 AND NOT is_sidechain)
SELECT session_id, kind, count(*) AS n FROM (
 SELECT session_id, 'TOOL' AS kind FROM x WHERE is_call UNION ALL SELECT session_id, CASE WHEN is_error THEN 'RESULT_ERR' ELSE 'RESULT' END FROM x WHERE is_result) GROUP BY 1, 2""")
def _(spark, sf):
    good, _ = L.parse_json(raw_lines_a(spark, sf))
    return NA.digest_items_a(good).groupBy("session_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("t9_digest_order", """
WITH x AS (SELECT * FROM u WHERE k % 41 <> 5 AND NOT is_sidechain AND event_type <> 'signup')
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY epoch_us(ts) // 1000, file_id, event_id) - 1 AS pos,
 CASE WHEN is_call THEN 'TOOL' WHEN is_error THEN 'RESULT_ERR' ELSE 'RESULT' END AS kind FROM x""")
def _(spark, sf):
    good, _ = L.parse_json(raw_lines_a(spark, sf))
    return D.number_items(NA.digest_items_a(good)).select("session_id", "pos", "kind")


@query("d4_digest_items_b", """
SELECT session_id, CASE event_type WHEN 'click' THEN 'TOOL' ELSE 'RESULT' END AS kind, count(*) AS n FROM u WHERE event_type IN ('click', 'error') GROUP BY 1, 2""")
def _(spark, sf):
    good, _ = L.parse_json(raw_lines_b(spark, sf))
    return NB.digest_items_b(good).groupBy("session_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("s11_commit_log", """
SELECT l_orderkey % 100 AS repo, count(*) AS commits, min(lpad(CAST(l_orderkey AS VARCHAR), 8, '0')) AS first_hash, epoch_us(max(l_shipdate)) AS last_ts,
 sum(length('ship ' || l_linestatus || chr(9) || l_returnflag))::BIGINT AS subject_chars FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1""", on_u=False)
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    full = F.concat_ws("\t", F.concat(F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), F.lit("ffffffff")), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
                       F.concat(F.lit("ship "), "l_linestatus"), F.col("l_returnflag"))
    raw = l.select((F.col("l_orderkey") % 100).alias("repo"), F.when(F.col("l_linenumber") == 3, F.lit("short")).otherwise(full).alias("value"))
    return parse_commits(raw, "repo").groupBy("repo").agg(
        F.count(F.lit(1)).alias("commits"), F.min("hash").alias("first_hash"), F.max("commit_ts").alias("last_ts"), F.sum(F.length("subject")).alias("subject_chars"))


@query("s13_report_json", """
SELECT repo, '{"tokens":' || sum(total)::BIGINT || ',"sessions":' || count(DISTINCT CASE WHEN NOT is_sidechain THEN session_id END) || ',"branches":' || count(DISTINCT branch) || '}' AS document FROM u GROUP BY 1""")
def _(spark, sf):
    return sinks.to_report_json(by_repo(events_as_ev(spark, sf)).select("repo", "tokens", "sessions", "branches"), "repo")
