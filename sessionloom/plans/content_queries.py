"""Redaction, digests and previews over ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.redact import mask, redact
from ..operators import content as D, joins as J, sessions as S, topk as K
from .adapters import events_as_ev, pick, table, texts
from .behavior_queries import PROMPT_FLAGS_SQL
from .registry import query

WS = r"[\s\x{000b}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
NOT_WS = WS.replace("[", "[^", 1)


def mask_sql(t: str) -> str:
    steps = [
        ("sk-[A-Za-z0-9_-]{12,}", "sk-REDACTED", "g"), ("ghp_[A-Za-z0-9]{12,}", "ghp_REDACTED", "g"),
        ("xox[baprs]-[A-Za-z0-9-]{10,}", "xox-REDACTED", "g"), ("AKIA[0-9A-Z]{12,}", "AKIA-REDACTED", "g"),
        (rf"(api[_-]?key|token|secret|password|authorization){WS}*[:=]{WS}*{NOT_WS}+", r"\1=REDACTED", "gi"),
        (r"[\w.+-]+@[\w-]+\.[\w.-]+", "<email>", "g"), (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<ip>", "g"),
        (r"(?:/[\w.\-]+){2,}/([\w.\-]+)", r"/…/\1", "g"),
    ]
    for pattern, replacement, flags in steps:
        t = f"regexp_replace({t}, '{pattern}', '{replacement}', '{flags}')"
    return t


def trim_sql(t: str) -> str:
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


def redact_sql(t: str, limit: int) -> str:
    m = trim_sql(mask_sql(t))
    return f"(SELECT CASE WHEN length(m) > {limit} THEN regexp_replace(substr(m, 1, {limit}), '{WS}+$', '') || ' …[truncated]' ELSE m END FROM (SELECT {m} AS m))"


@query("h10_mask", f"SELECT doc_id, md5({mask_sql('text')}) AS masked FROM documents", on_u=False)
def _(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", F.md5(mask(F.col("text"))).alias("masked"))


@query("d1_redact", f"SELECT doc_id, md5({redact_sql('text', 200)}) AS preview FROM documents", on_u=False)
def _(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", F.md5(redact(F.col("text"), 200)).alias("preview"))


@query("d2_prompt_preview", f"""
WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, {trim_sql('text')} AS t FROM conversations WHERE role = 'user' AND {trim_sql('text')} <> '')
SELECT conv_id, turn, idx, len, structured = 1 AS structured, file_ref = 1 AS file_ref, constr = 1 AS "constraint", correction = 1 AS correction, preview
FROM (SELECT conv_id, turn, idx, {PROMPT_FLAGS_SQL}, {redact_sql('t', 1200)} AS preview FROM p)""", on_u=False)
def _(spark, sf):
    prompts = texts(spark, sf, "conversations").filter(F.col("role") == "user")
    return D.prompt_preview(prompts, ["conv_id"], "turn", "text")


@query("d2_selected_session", """
WITH top AS (SELECT session_id FROM u WHERE NOT is_sidechain GROUP BY 1 ORDER BY sum(total) DESC, count(*) FILTER (WHERE is_call) DESC, 1 LIMIT 1)
SELECT session_id, row_number() OVER (ORDER BY ts, file_id, event_id) - 1 AS idx, length(prompt_text) AS len, md5(prompt_text) AS preview
FROM u WHERE is_boundary AND session_id IN (SELECT session_id FROM top)""")
def _(spark, sf):
    ev = events_as_ev(spark, sf)
    top = K.top_sessions(S.session_candidates_a(ev).select("session_id", "tokens", "tool_calls"), 1)
    return D.selected_session_preview(ev, top).select("session_id", "idx", "len", F.md5("preview").alias("preview"))


ITEMS_SQL = f"""
i AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'ASSISTANT' WHEN 'user' THEN 'RESULT' ELSE 'TOOL' END AS kind, length(text) AS raw_chars,
 {redact_sql(f"regexp_replace(text, '{WS}+', ' ', 'g')", 200)} AS preview FROM conversations),
p AS (SELECT *, sum(length(preview)) OVER (PARTITION BY conv_id ORDER BY turn) - length(preview) < 600 AS emitted FROM i)"""


def _items(spark, sf):
    role = F.col("role")
    kind = F.when(role == "assistant", F.lit("ASSISTANT")).when(role == "user", F.lit("RESULT")).otherwise(F.lit("TOOL"))
    return texts(spark, sf, "conversations").select("conv_id", "turn", kind.alias("kind"), "text")


@query("d5_pack_digest", f"WITH {ITEMS_SQL} SELECT conv_id, turn, kind, md5(preview) AS preview FROM p WHERE emitted", on_u=False)
def _(spark, sf):
    packed = D.pack_items(_items(spark, sf), ["conv_id"], "turn", 200, 600)
    return D.digest_items(packed).withColumn("preview", F.md5("preview"))


@query("d5_digest_stats", f"""WITH {ITEMS_SQL}
SELECT conv_id, count(*) AS items, count(*) FILTER (WHERE emitted) AS emitted_items, count(*) FILTER (WHERE NOT emitted) AS dropped, sum(raw_chars)::BIGINT AS raw_chars,
 coalesce(sum(length(preview)) FILTER (WHERE emitted), 0)::BIGINT AS emitted_chars,
 floor(coalesce(sum(length(preview)) FILTER (WHERE emitted), 0)::DOUBLE / 4.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS est_tokens FROM p GROUP BY 1""", on_u=False)
def _(spark, sf):
    return D.digest_stats(D.pack_items(_items(spark, sf), ["conv_id"], "turn", 200, 600), ["conv_id"])


@query("d6_tool_input_summary", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'cmd: c' || user_id WHEN 1 THEN 'file p' || user_id || ' | -o' || event_id || ' +n' || event_id
 WHEN 2 THEN 'file p' || user_id || ' | body' || event_id WHEN 3 THEN 'file p' || user_id WHEN 4 THEN 'q pat' || event_id || ' @ src'
 ELSE '{"x":' || event_id || '}' END AS summary FROM events""", on_u=False)
def _(spark, sf):
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    name = pick(["Bash", "Edit", "Write", "Read", "Grep", "Other"], F.col("event_id"))
    values = {"command": F.concat(F.lit("c"), u), "file_path": F.concat(F.lit("p"), u), "old_string": F.concat(F.lit("o"), e),
              "new_string": F.concat(F.lit("n"), e), "content": F.concat(F.lit("body"), e), "pattern": F.concat(F.lit("pat"), e),
              "glob": F.lit("src"), None: F.concat(F.lit('{"x":'), e, F.lit("}"))}
    field = lambda key: values.get(key, F.lit(None).cast("string"))
    return table(spark, sf, "events").select("event_id", D.tool_input_summary(name, field).alias("summary"))
