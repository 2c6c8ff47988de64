"""Streams over the landed event table, drained with ``availableNow`` and compared with batch SQL under the same lateness rule.

The records arrive in twelve batches, some a batch behind, some three batches behind and so too late, and some twice; a last
batch holds one far record that moves the watermark on, as the next day's records would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.joins import dedup_key
from ..schema import STRIDE
from ..session import new_path
from ..streaming import episodes as SE, landing as SL, merge as SM, windows as SW
from .adapters import events_as_ev, events_wide, plan_cache, table
from .episode_queries import CAP, EP_FILLED
from .registry import query, ratio4_sql, with_u

ARRIVALS = 12
LATENESS_SECONDS = 3 * 86_400
#: Lateness and the span of one landed batch: what the operators behind the landing wait for.
WAIT = "6 days"
COPIES = 13
#: Records of one file of an arrival.
FILE_ROWS = 100_000

# The same rule twice: as columns of the stream, and as reference SQL.
BASE_SQL = f"event_id * {ARRIVALS} // (SELECT max(event_id) + 1 FROM events)"
ON_TIME_SQL = f"""
al AS (SELECT event_id, ts, {BASE_SQL} + CASE WHEN event_id % 37 = 5 THEN 3 WHEN event_id % 11 = 3 THEN 1 ELSE 0 END AS a0 FROM events),
ar AS (SELECT event_id, ts, least(a0, {ARRIVALS - 1}) AS arrival, false AS copy FROM al
 UNION ALL SELECT event_id, ts, least(a0 + 1, {ARRIVALS - 1}), true FROM al WHERE event_id % {COPIES} = 2),
ck AS (SELECT arrival, max(max(epoch_us(ts))) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock FROM ar GROUP BY arrival),
fate AS (SELECT event_id, copy, coalesce(epoch_us(ts) <= clock - {LATENESS_SECONDS * 1_000_000}, false) AS late FROM ar JOIN ck USING (arrival)),
uo AS (SELECT * FROM u WHERE event_id IN (SELECT event_id FROM fate WHERE NOT late AND NOT copy))"""


def late_sql(sql: str, source: str = ON_TIME_SQL) -> str:
    """Put the rows on time, ``uo``, in front of a statement."""
    body = sql.strip()
    return f"WITH {source.strip()}" + (f",\n{body[5:]}" if body.upper().startswith("WITH ") else f"\n{body}")


@plan_cache
def _landed(spark, sf) -> tuple:
    """Folder of the landed stream, schema of its records, and the number of files of each landed batch."""
    ev = events_as_ev(spark, sf)
    rows = ev.withColumn("_e", F.expr(f"seq div {STRIDE}"))
    last = table(spark, sf, "events").agg(F.max("event_id") + 1).first()[0] or 1
    e = F.col("_e")
    first = F.expr(f"_e * {ARRIVALS} div {last}") + F.when(e % 37 == 5, 3).when(e % 11 == 3, 1).otherwise(0)
    copies = F.when(e % COPIES == 2, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    arrival = F.least(first + F.col("copy").cast("int"), F.lit(ARRIVALS - 1)).alias("arrival")
    rows = rows.withColumn("copy", F.explode(copies)).select(*ev.columns, arrival, "copy")
    folder, staged = new_path(spark, "stream-in"), new_path(spark, "stream-arrivals")
    with SE.session_settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": str(ARRIVALS)}):  # a task needn't sort its rows by arrival
        rows.write.partitionBy("arrival").parquet(staged)
    schema = rows.drop("arrival").schema
    files = 1 + ev.count() // (ARRIVALS * FILE_ROWS)
    # a trigger takes the files of one arrival: each has a folder of its own, and all have the same number of files
    for a in range(ARRIVALS):
        part = spark.read.schema(rows.schema).parquet(staged).filter(F.col("arrival") == a).drop("arrival")
        SL.write_files(part, f"{folder}/arrival={a:02d}", files)
    far = ev.agg((F.max("ts") + F.expr("INTERVAL 90 DAY")).alias("ts"))
    values = {"ts": F.col("ts"), "file_id": F.lit("clock"), "seq": F.lit(1), "kind": F.lit("tool_result"), "total": F.lit(0),
              "is_sidechain": F.lit(False), "copy": F.lit(False)}
    far = far.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    SL.write_files(far, f"{folder}/arrival={ARRIVALS:02d}", files)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).select(*schema.names)
    stream = stream.filter(F.col("copy").isNotNull())  # rows that only stand for a file have no values at all
    path = new_path(spark, "stream-landed")
    SL.land(stream, path, new_path(spark, "stream-cp"), LATENESS_SECONDS, files)
    return path, schema, files


def arrived(spark, sf, copies: bool = False) -> DataFrame:
    """Stream of the landed records, one landed batch at a time."""
    path, schema, files = _landed(spark, sf)
    rows = SL.on_time(spark, path, schema, files)
    return rows if copies else rows.filter(~F.col("copy"))


def appended(spark, stream: DataFrame) -> DataFrame:
    """The rows of an append-mode stream; its state lies on disk and has as many partitions as the cores need in each step."""
    path = new_path(spark, "stream-out")
    with SE.session_settings(spark, SE.settings(spark)):
        SW.append(stream, path, new_path(spark, "stream-cp"))
    return spark.read.schema(stream.schema).parquet(path)


DAY_SQL = """SELECT epoch_us(date_trunc('day', ts)) // 1000000 AS start, platform, model_norm AS model, sum(total)::BIGINT AS tokens, count(*) AS records FROM uo GROUP BY 1, 2, 3"""


@query("r1_stream_usage_by_day", late_sql(DAY_SQL.replace(
    "FROM uo", "FROM u WHERE event_id IN (SELECT event_id FROM fate WHERE NOT late)")))
def _(spark, sf):
    rows = arrived(spark, sf, copies=True).withColumn("record", F.concat_ws(":", "file_id", "seq"))
    return appended(spark, SW.usage_by_day(rows, "record", WAIT))


@query("r1_late_records", late_sql("SELECT copy AS repeated, count(*) AS records FROM fate WHERE late GROUP BY 1"))
def _(spark, sf):
    path, schema, _ = _landed(spark, sf)
    late = SL.late_records(spark, path, schema).filter(F.col("total").isNotNull())
    return late.groupBy(F.col("copy").alias("repeated")).agg(F.count(F.lit(1)).alias("records"))


@query("r2_stream_usage_by_hour", late_sql("SELECT epoch_us(date_trunc('hour', ts)) // 1000000 AS start, sum(total)::BIGINT AS tokens, count(*) AS records FROM uo GROUP BY 1"))
def _(spark, sf):
    return appended(spark, SW.usage_by_hour(arrived(spark, sf), WAIT))


@query("r3_stream_activity_sessions", late_sql("""
WITH g AS (SELECT session_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session_id ORDER BY ts)) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM uo),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT session_id, epoch_us(min(ts)) // 1000000 AS start, count(*) AS records, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_micros FROM s GROUP BY session_id, n"""))
def _(spark, sf):
    return appended(spark, SW.activity_sessions(arrived(spark, sf), "6 hours", "session_id", lateness=WAIT))


@query("r3_stream_active_seconds", late_sql(f"""
WITH a AS (SELECT file_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY file_id ORDER BY event_id)) AS gap FROM uo WHERE NOT is_sidechain)
SELECT file_id, sum(CASE WHEN gap BETWEEN 1 AND {CAP * 1_000_000} THEN gap ELSE 0 END)::BIGINT // 1000000 AS active_seconds FROM a GROUP BY 1"""))
def _(spark, sf):
    """Active time of files from their activity sessions; the batch operator's cap includes its end, so the gap is a microsecond more."""
    main = arrived(spark, sf).filter(~F.col("is_sidechain"))
    sessions = appended(spark, SW.activity_sessions(main, f"{CAP} seconds 1 microsecond", "file_id", lateness=WAIT))
    return sessions.groupBy("file_id").agg(F.expr("sum(span_micros) div 1000000").alias("active_seconds"))


@query("r6_stream_error_rate", late_sql(f"""
WITH w AS (SELECT (epoch_us(ts) // 900000000 - i) * 900 AS start, is_error FROM uo, (VALUES (0), (1), (2), (3)) AS s(i) WHERE is_result)
SELECT start, count(*) AS results, count(*) FILTER (WHERE is_error) AS errors, {ratio4_sql('count(*) FILTER (WHERE is_error)', 'count(*)')} AS error_rate FROM w GROUP BY 1"""))
def _(spark, sf):
    return appended(spark, SW.error_rate(arrived(spark, sf), lateness=WAIT))


@query("r5_stream_max_usage", """
SELECT dedup_key, total FROM (SELECT user_id || ':' || event_id // 3 AS dedup_key, total, row_number() OVER (PARTITION BY user_id, event_id // 3 ORDER BY total DESC, file_id, event_id) AS r FROM u) WHERE r = 1""")
def _(spark, sf):
    """Twelve batches in another order than the records', merged every five."""
    folder, out = new_path(spark, "stream-usage"), new_path(spark, "stream-max")
    key = dedup_key(F.col("user_id").cast("string"), F.expr("event_id div 3").cast("string"), F.lit(""))
    rows = events_wide(spark, sf).select("file_id", F.col("event_id").alias("seq"), key.alias("dedup_key"), *[F.col(c) for c in SM.TOKEN_BUCKETS])
    rows.repartition(ARRIVALS, F.col("seq") % ARRIVALS).write.parquet(folder)
    merged = SM.MaxUsageTable(spark, out, every=5)
    merged.run(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder), new_path(spark, "stream-cp"))
    return merged.current().select("dedup_key", "total")


@query("r4_stream_episodes", with_u("WITH " + ON_TIME_SQL.strip() + ",\n" + EP_FILLED.replace("FROM u WHERE", "FROM uo WHERE") + """
SELECT file_id, ep, start_id, platform, session_id, repo, epoch_us(start_ts) AS start_ts, epoch_us(greatest(start_ts, last_ts)) AS end_ts, input, cached_input, output, reasoning_output, cache_creation,
 total, cost_usd, tool_calls, files_touched, max_edits_per_file, errors, active_ms, error_run, quiet_run, interrupted, end_type, task_type, task_type_confidence,
 edit_ring, error_dense, no_progress, effort, model, thinking_directive, compacted FROM ty"""), on_u=False)
def _(spark, sf):
    done = appended(spark, SE.stream_episodes(arrived(spark, sf, copies=True), CAP, 8 * 86_400, WAIT))
    return done.select(
        "file_id", "ep", F.expr(f"start_seq div {STRIDE}").alias("start_id"), "platform", "session_id", "repo", "start_ts",
        F.greatest("start_ts", "last_ts").alias("end_ts"), *SM.TOKEN_BUCKETS, "cost_usd", "tool_calls", "files_touched", "max_edits_per_file", "errors",
        "active_ms", "error_run", "quiet_run", "interrupted", "end_type", "task_type", "task_type_confidence", "edit_ring", "error_dense",
        "no_progress", "effort", "model", "thinking_directive", "compacted")
