"""Registry of named queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import corpus as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, days as text, timestamps as epoch microseconds: equal types in both engines."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.DecimalType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, on_u: bool = True):
    """Register a query; ``sql`` reads the view ``u`` unless ``on_u`` is false."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
        if sql is not None:
            SQL[name] = (with_u(sql) if on_u else sql).strip()
        return fn
    return add


def sql_list(values: list[str], index: str) -> str:
    items = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{items}])[CAST({index} AS BIGINT) % {len(values)} + 1]"


def ratio_sql(part: str, whole: str) -> str:
    return f"(CASE WHEN ({whole}) > 0 THEN ({part})::DOUBLE / ({whole})::DOUBLE ELSE 0.0::DOUBLE END)"


def round_sql(value: str, digits: int = 4) -> str:
    scale = f"{10**digits}.0::DOUBLE"
    return f"(floor(({value}) * {scale} + 0.5::DOUBLE) / {scale})"


def ratio4_sql(part: str, whole: str) -> str:
    return round_sql(ratio_sql(part, whole))


def us(ts: str) -> str:
    return f"epoch_us({ts})"


BASE = r"regexp_extract({0}, '([^\\/]*)$', 1)"
NORM = ("CASE WHEN starts_with(lower(trim({0})), 'codex-mini') THEN 'codex-mini' "
        "WHEN starts_with(lower(trim({0})), 'gpt5') THEN 'gpt-5' || substr(lower(trim({0})), 5) ELSE lower(trim({0})) END")


def sql_words(text: str) -> str:
    return rf"list_filter(string_split_regex({text}, '\s+'), lambda w: w <> '')"


def first_token_sql(text: str) -> str:
    return BASE.format(rf"coalesce(list_filter({sql_words(text)}, lambda w: NOT regexp_matches(w, '^[A-Za-z_][A-Za-z0-9_]*='))[1], '')")


def git_sql(text: str) -> str:
    from ..functions.text import GIT_SUBCOMMANDS
    names = ", ".join(f"'{g}'" for g in GIT_SUBCOMMANDS)
    w = sql_words(text)
    at = f"list_position(list_transform({w}, lambda x: {BASE.format('x')}), 'git')"
    sub = f"lower({BASE.format(f'list_filter(({w})[{at} + 1:], lambda x: NOT starts_with(x, chr(45)))[1]')})"
    return f"(CASE WHEN {at} > 0 AND {sub} IN ({names}) THEN {sub} END)"


ERROR_SQL = r"""(CASE
 WHEN regexp_matches({0}, 'not been read|read it first before', 'i') THEN 'not-read'
 WHEN regexp_matches({0}, 'permission denied|EACCES|not permitted|operation not permitted', 'i') THEN 'permission'
 WHEN regexp_matches({0}, 'ETIMEDOUT|timed out|deadline exceeded', 'i') THEN 'timeout'
 WHEN regexp_matches({0}, 'ECONNREFUSED|ENOTFOUND|EAI_AGAIN|getaddrinfo|fetch failed|network is unreachable', 'i') THEN 'network'
 WHEN regexp_matches({0}, '\bFAIL\b|tests? failed|assertionerror|✗ ', 'i') THEN 'test'
 WHEN regexp_matches({0}, 'fatal:|not a git repository|exit code 128', 'i') THEN 'git'
 WHEN regexp_matches({0}, 'npm (err|error)|cannot find module|\btsc\b|build failed|cargo |compil(e|ation)|\bgo: ', 'i') THEN 'build'
 ELSE 'other' END)"""
CORRECTION_SQL = r"regexp_matches({0}, '\b(actually|sorry|wait|wrong|instead|nope|no,)\b|不对|不是|错了|重来|撤销|改成', 'i')"
THINKING_SQL = r"regexp_matches({0}, '\b(ultrathink|megathink|think\s+(hard|harder|deeply|intensely|longer))\b', 'i')"
LONG_RUN_SQL = r"regexp_matches({0}, '\b(train|fit|pytest|jest|vitest|benchmark|bench|notebook|jupyter)\b', 'i')"
HUMAN_SQL = (r"(NOT regexp_matches({0}, '</?(command-name|command-message|command-args|local-command-stdout|local-command-stderr)>', 'i')"
             r" AND NOT regexp_matches({0}, '\[Request interrupted by user', 'i') AND trim({0}) <> '')")


def price_values() -> str:
    from ..functions.models import PRICES
    rows = ", ".join(
        f"('{p}', {round(a * 1000)}, {round(b * 1000)}, {round(c * 1000)}, {'NULL' if d is None else round(d * 1000)})"
        for p, (a, b, c, d) in PRICES.items())
    return f"prices(prefix, p_in, p_cached, p_out, p_write) AS (VALUES {rows})"


def label_sql() -> str:
    cases = " ".join(f"WHEN '{f}' THEN {sql_list(C.LABELS[f], 'k')}" for f in C.LABEL_FIELDS)
    return f"CASE {sql_list(C.LABEL_FIELDS, 'event_id')} {cases} END"


def u_ctes() -> str:
    return f"""
{price_values()},
u0 AS (
 SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CAST(floor(value * 100) AS BIGINT) AS input, {sql_list(C.MODELS, 'event_id')} AS model
 FROM events),
u1 AS (
 SELECT *, 'f' || user_id || '-' || weekofyear(ts) AS file_id, 's' || user_id AS session_id, 'repo' || (k % 20) AS repo,
  'b' || (event_id % 3) AS branch, k % 17 = 0 AS is_sidechain, starts_with(model, 'claude') AS claude,
  {NORM.format('model')} AS model_norm, (input * (k % 10)) // 10 AS cached_input, event_id % 1000 AS output,
  CASE event_type WHEN 'click' THEN 'Bash' WHEN 'purchase' THEN CASE WHEN k % 3 <> 0 THEN 'Edit' ELSE 'Read' END
   WHEN 'view' THEN CASE k % 5 WHEN 0 THEN 'mcp__srv' || (k % 3) || '__tool' || (k % 4) WHEN 1 THEN 'WebSearch' WHEN 2 THEN 'Task' ELSE 'Grep' END
   WHEN 'error' THEN {sql_list(C.RESULT_TOOLS, 'k')} END AS tool_name,
  {sql_list(C.EXTENSIONS, 'k')} AS ext0,
  CASE WHEN event_type = 'click' THEN {sql_list(C.COMMANDS, 'event_id')} END AS command,
  CASE WHEN event_type = 'signup' THEN {sql_list(C.PROMPTS, 'event_id')} END AS prompt_text,
  CASE WHEN event_type = 'error' THEN {sql_list(C.ERRORS, 'event_id')} END AS error_text,
  CASE WHEN event_id % 4 = 0 THEN {sql_list(C.SOURCES, 'user_id')} ELSE '' END AS source,
  {sql_list(C.LABEL_FIELDS, 'event_id')} AS label_field, {label_sql()} AS label,
  CASE k % 3 WHEN 1 THEN 'plus' WHEN 2 THEN 'pro' END AS plan
 FROM u0),
model_price AS (
 SELECT m.model_norm, arg_max(p_in, length(prefix)) AS p_in, arg_max(p_cached, length(prefix)) AS p_cached,
  arg_max(p_out, length(prefix)) AS p_out, arg_max(coalesce(p_write, -1), length(prefix)) AS p_write
 FROM (SELECT DISTINCT model_norm FROM u1) m JOIN prices ON starts_with(m.model_norm, prefix) GROUP BY 1),
u AS (
 SELECT u1.*, p_in IS NOT NULL AS priced, CASE WHEN claude THEN 'A' ELSE 'B' END AS platform,
  CASE WHEN claude THEN 0 ELSE (event_id % 1000) // 4 END AS reasoning_output, CASE WHEN claude THEN k ELSE 0 END AS cache_creation,
  CASE WHEN claude THEN input + cached_input + output + k ELSE input + output END AS total,
  CASE WHEN claude THEN input ELSE greatest(0, input - least(cached_input, input)) END AS fresh,
  CASE WHEN p_in IS NULL THEN 0 WHEN p_write >= 0 THEN input * p_in + cached_input * p_cached + k * p_write + output * p_out
   ELSE (input - least(cached_input, input)) * p_in + least(cached_input, input) * p_cached + output * p_out END AS nano,
  event_type IN ('view', 'click', 'purchase') AS is_call,
  CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN NULL WHEN tool_name = 'Bash' THEN 'shell' WHEN tool_name = 'WebSearch' THEN 'web'
   WHEN tool_name IN ('Edit', 'Read') THEN 'file' WHEN tool_name = 'Grep' THEN 'search' WHEN starts_with(tool_name, 'mcp__') THEN 'mcp' ELSE 'other' END AS tool_kind,
  event_type = 'purchase' AND k % 3 <> 0 AS is_edit,
  CASE WHEN event_type = 'purchase' THEN 'file' || (k % 7) || '.' || ext0 END AS file_base,
  CASE WHEN event_type = 'purchase' THEN ext0 END AS file_ext,
  event_type = 'error' AS is_result, event_type = 'error' AND k % 4 <> 0 AS is_error,
  CASE WHEN event_type = 'error' AND k % 4 <> 0 THEN {ERROR_SQL.format('error_text')} END AS error_category,
  coalesce(event_type = 'signup' AND k % 17 <> 0 AND {HUMAN_SQL.format('prompt_text')}, false) AS is_boundary,
  CASE WHEN k % 17 = 0 THEN 'subagent' WHEN k % 23 = 1 THEN 'compaction' WHEN k % 29 = 2 THEN 'abort' WHEN k % 31 = 3 THEN 'attachment'
   WHEN k % 37 = 4 THEN 'api_error' WHEN event_type = 'error' AND k % 9 = 1 THEN 'interrupt' END AS marker
 FROM u1 LEFT JOIN model_price USING (model_norm))"""


def with_u(sql: str) -> str:
    """Put the CTEs of ``u`` in front of a statement that may start with its own WITH."""
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {u_ctes()},\n{body[5:]}"
    return f"WITH {u_ctes()}\n{body}"
