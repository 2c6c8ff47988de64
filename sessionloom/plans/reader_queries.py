"""Readers over files that Spark writes from the tables, message texts, and the prompts of platform B logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import behavior as B
from ..session import _file_system, new_path
from ..sources import logs as L, normalize_a as NA, normalize_b as NB
from .adapters import events_wide, plan_cache, table
from .behavior_queries import PROMPT_FLAGS_SQL, SIGNALS_SQL
from .log_queries import _iso, raw_lines_b
from .registry import HUMAN_SQL, query

PARTS = 6


@plan_cache
def _log_folder(spark, sf) -> str:
    """Six folders of ``.jsonl`` files with one line per event, every other file with the name of a rollout, and a copy of all lines as text files."""
    path = new_path(spark, "log-files")
    e = table(spark, sf, "events").select((F.col("event_id") % PARTS).alias("part"), "event_id", F.concat_ws(":", "event_type", "event_id").alias("value"))
    sorted_rows = e.repartition(PARTS, "part").sortWithinPartitions("part", "event_id").select("part", "value")
    sorted_rows.write.partitionBy("part").text(f"{path}/logs")
    sorted_rows.write.partitionBy("part").text(f"{path}/logs/other")
    files, _ = _file_system(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for part in range(PARTS):  # a few names, no content
        for status in files.globStatus(hadoop(f"{path}/logs/part={part}/*.txt")) or []:
            name = f"rollout-{part}+a b.jsonl" if part % 2 else f"log {part}.jsonl"
            files.rename(status.getPath(), hadoop(status.getPath().getParent(), name))
    return f"{path}/logs"


def _numbered(raw: DataFrame) -> DataFrame:
    part = F.regexp_extract("file_id", r"part=(\d+)/", 1).cast("bigint")
    return raw.select(part.alias("part"), F.regexp_extract("file_id", r"([^/]*)\z", 1).alias("file"), "line_no", F.md5(F.col("value").cast("binary")).alias("line"))


LINES_SQL = f"""SELECT part, CASE WHEN part % 2 = 1 THEN 'rollout-' || part || '+a b.jsonl' ELSE 'log ' || part || '.jsonl' END AS file, line_no, line FROM (
 SELECT event_id % {PARTS} AS part, row_number() OVER (PARTITION BY event_id % {PARTS} ORDER BY event_id) - 1 AS line_no, md5(event_type || ':' || event_id) AS line FROM events)"""


@query("s1_read_logs_a", LINES_SQL, on_u=False)
def _(spark, sf):
    return _numbered(L.read_logs_a(spark, _log_folder(spark, sf)))


@query("s2_read_logs_b", LINES_SQL + " WHERE part % 2 = 1", on_u=False)
def _(spark, sf):
    return _numbered(L.read_logs_b(spark, _log_folder(spark, sf)))


@query("s15_read_log_files", LINES_SQL + " WHERE part IN (2, 3)", on_u=False)
def _(spark, sf):
    folder = _log_folder(spark, sf)
    return _numbered(L.read_log_files(spark, f"{folder}/part=2/log 2.jsonl", f"{folder}/part=3/rollout-3+a b.jsonl"))


def _contents(spark, sf) -> DataFrame:
    """Messages as they stand in logs: a text, a list of one block, a list of several kinds of items, or nothing."""
    c = table(spark, sf, "conversations")
    block = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    image = F.struct(F.lit("image").alias("type"), F.lit("hidden").alias("text"))
    turn = F.col("turn") % 4
    mixed = F.concat(F.lit("["), F.to_json(block), F.lit(","), F.to_json(F.array("role")).substr(F.lit(2), F.length(F.to_json(F.array("role"))) - 2),
                     F.lit(","), F.to_json(image), F.lit("]"))
    body = F.when(turn == 0, F.to_json(F.struct(F.col("text").alias("content")))).when(turn == 1, F.to_json(F.struct(F.array(block).alias("content")))).when(
        turn == 2, F.concat(F.lit('{"content":'), mixed, F.lit("}"))).otherwise(F.lit("{}"))
    return c.select("conv_id", "turn", L.get(F.parse_json(body), "$.content", "variant").alias("content"))


@query("h17_block_text", """
SELECT conv_id, turn, md5(CASE turn % 4 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN coalesce(text, '') WHEN 2 THEN concat_ws(chr(10), text, role) ELSE '' END) AS text FROM conversations""", on_u=False)
def _(spark, sf):
    return _contents(spark, sf).select("conv_id", "turn", F.md5(F.coalesce(NA.block_text(F.col("content")), F.lit("")).cast("binary")).alias("text"))


@query("h18_result_text", """
SELECT conv_id, turn, md5(CASE turn % 4 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN coalesce(text, '') WHEN 2 THEN coalesce(text, '') || '  hidden' ELSE '' END) AS text FROM conversations""", on_u=False)
def _(spark, sf):
    return _contents(spark, sf).select("conv_id", "turn", F.md5(F.coalesce(NA.result_block_text(F.col("content")), F.lit("")).cast("binary")).alias("text"))


@query("p11_prompt_signals_b", rf"""
WITH m AS (SELECT session_id, trim(regexp_replace(prompt_text, '\s+', ' ', 'g')) AS t FROM u WHERE event_type = 'signup' AND user_id % 9 <> 4),
p AS (SELECT session_id, {PROMPT_FLAGS_SQL} FROM m WHERE {HUMAN_SQL.format('t')})
SELECT session_id, {SIGNALS_SQL} FROM p GROUP BY 1""")
def _(spark, sf):
    """Prompt measures of sub-agent-free platform B logs, from user messages with one text part."""
    u = events_wide(spark, sf).filter(F.col("event_type") == "signup")
    part = F.struct(F.lit("input_text").alias("type"), F.col("prompt_text").alias("text"))
    message = F.struct(F.lit("message").alias("type"), F.lit("user").alias("role"), F.array(part).alias("content"))
    line = F.to_json(F.struct(F.lit("response_item").alias("type"), _iso(F.col("ts")).alias("timestamp"), message.alias("payload")))
    said = u.select("file_id", (F.col("event_id") + 1).alias("line_no"), line.alias("value"))
    head = raw_lines_b(spark, sf).filter(F.col("line_no") == 0)
    good, _ = L.parse_json(head.unionByName(said))
    return B.ev_prompt_signals(NB.normalize_b(good), "session_id")
