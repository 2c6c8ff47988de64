"""Streams: lateness, repeats, bounded state, keyed merges, and episodes that close."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import episodes as E
from sessionloom.operators.joins import max_usage
from sessionloom.plans import stream_queries
from sessionloom.schema import EV_FIELDS, STRIDE, as_ev
from sessionloom.session import path_exists
from sessionloom.streaming import episodes as SE, landing as SL, merge as SM, windows as SW

DAY0 = dt.datetime(2024, 3, 1)
EV = ", ".join(f"{n} {t}" for n, t in EV_FIELDS)


def source(spark, tmp_path, batches, schema):
    """A file stream with one file a batch, in order."""
    folder = f"{tmp_path}/in"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


USAGE = "file_id string, seq bigint, ts timestamp_ntz, platform string, model string, total bigint"


def usage(i, hours, model="claude-x"):
    return (f"f{i % 3}", i, DAY0 + dt.timedelta(hours=hours), "A", model, i + 1)


def landed(spark, tmp_path, batches, lateness, schema=USAGE):
    path = f"{tmp_path}/landed"
    SL.land(source(spark, tmp_path, batches, schema), path, f"{tmp_path}/cp", lateness)
    return path, spark.createDataFrame([], schema).schema


def test_late_rows_are_kept_apart(spark, tmp_path):
    batches = [[usage(0, 1), usage(1, 10)], [usage(2, 20)], [usage(3, 12), usage(4, 14.5), (None, 9, None, None, None, 1)]]
    path, schema = landed(spark, tmp_path, batches, 6 * 3600)
    assert sorted(r.seq for r in SL.late_records(spark, path, schema).collect()) == [3, 9]
    assert sorted(r.seq for r in spark.read.schema(schema).parquet(f"{path}/on_time").collect()) == [0, 1, 2, 4]


def test_landing_repeats_nothing(spark, tmp_path):
    batches = [[usage(0, 1)], [usage(1, 2)]]
    path, schema = landed(spark, tmp_path, batches, 3600)
    stream = spark.readStream.schema(USAGE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    SL.land(stream, path, f"{tmp_path}/cp2", 3600)  # a lost checkpoint: the same batches again
    assert sorted(r.seq for r in spark.read.schema(schema).parquet(f"{path}/on_time").collect()) == [0, 1]


def test_repeats_and_bounded_state(spark, tmp_path):
    """Fifteen days, each with repeats of the day before: the result is the batch result, the state holds some days only."""
    days = [[usage(100 * d + i, 24 * d + i) for i in range(20)] for d in range(15)]
    batches = [rows + (days[d - 1][:10] if d else []) for d, rows in enumerate(days)] + [[usage(9_999, 24 * 60)]]
    path, schema = landed(spark, tmp_path, batches, 86_400)
    rows = SL.on_time(spark, path, schema, 1).withColumn("record", F.concat_ws(":", "file_id", "seq"))
    out = f"{tmp_path}/out"
    progress = SW.append(SW.usage_by_day(rows, "record", "2 days"), out, f"{tmp_path}/cp3")
    got = {(r.start, r.tokens, r.records) for r in spark.read.parquet(out).collect()}
    first = int(DAY0.replace(tzinfo=dt.UTC).timestamp())
    assert got == {(first + 86_400 * d, sum(r[5] for r in days[d]), 20) for d in range(15)}
    assert SW.dropped_rows(progress) == 0 and len(progress) >= 16
    assert SW.largest_state(progress) <= 6 * 21  # of 300 records and 15 windows


def test_sessions_are_active_time(spark, tmp_path):
    """Spans of activity sessions sum up to the gaps that the batch operator counts, gaps of exactly the cap included."""
    minutes = [0, 3, 8, 13.5, 19, 19.2, 60, 64]
    batches = [[usage(i, m / 60) for i, m in enumerate(minutes)], [usage(99, 24 * 30)]]
    path, schema = landed(spark, tmp_path, batches, 86_400)
    out = f"{tmp_path}/out"
    SW.append(SW.activity_sessions(SL.on_time(spark, path, schema, 1), "5 minutes 1 microsecond", "platform", lateness="2 days"), out, f"{tmp_path}/cp3")
    gaps = [b - a for a, b in zip(minutes, minutes[1:]) if b - a <= 5]
    assert sum(r.span_micros for r in spark.read.parquet(out).collect()) == round(sum(gaps) * 60e6)


MAX = "dedup_key string, file_id string, seq bigint, input bigint, cached_input bigint, output bigint, reasoning_output bigint, cache_creation bigint, total bigint"


def test_keyed_merge(spark, tmp_path):
    """Twenty-three batches with later, larger and tied usage; reads stay small, old versions go."""
    batches = [[(f"k{(7 * b + i) % 10}" if i else None, f"f{i % 2}", 100 * b + i, i, b, 0, 0, 0, (b * i) % 17) for i in range(6)] for b in range(23)]
    stream = source(spark, tmp_path, batches, MAX)
    merged = SM.MaxUsageTable(spark, f"{tmp_path}/table", buckets=2, every=4)
    merged.run(stream, f"{tmp_path}/cp")
    rows = spark.createDataFrame([r for b in batches for r in b], MAX)
    want = sorted(map(tuple, max_usage(rows).collect()))
    assert sorted(map(tuple, merged.current().select(*max_usage(rows).columns).collect())) == want
    assert merged.version().batch == 19 and merged.version().number == 4
    assert len(merged.current().inputFiles()) <= 2 + 4 * 4  # base buckets and three open batches
    assert not path_exists(spark, f"{tmp_path}/table/base-2") and not path_exists(spark, f"{tmp_path}/table/delta-11")
    spark.sql("drop table max_usage_table_4")  # as in a session that never saw it
    again = SM.MaxUsageTable(spark, f"{tmp_path}/table", buckets=2, every=4)
    assert sorted(map(tuple, again.current().select(*max_usage(rows).columns).collect())) == want
    again.merge(spark.createDataFrame(batches[3], MAX), 3)  # an old batch once more
    assert sorted(map(tuple, again.current().select(*max_usage(rows).columns).collect())) == want


def event(file_id, line, hours, kind, **more):
    values = {"platform": "A", "file_id": file_id, "seq": line * STRIDE, "ts": DAY0 + dt.timedelta(hours=hours), "session_id": file_id, "repo": "r",
              "is_sidechain": False, "kind": kind, **more}
    return tuple(values.get(n) for n, _ in EV_FIELDS)


def prompt(file_id, line, hours, correction=False):
    return event(file_id, line, hours, "prompt", is_boundary=True, is_correction=correction)


def tokens(file_id, line, hours, model="claude-opus-4", n=10):
    return event(file_id, line, hours, "tokens", model=model, input=n, cached_input=0, output=1, reasoning_output=0, cache_creation=0, total=n + 1)


def call(file_id, line, hours, name, edit=True):
    return event(file_id, line, hours, "tool_call", tool_kind="file", file_base=name, file_ext="py", is_edit=edit)


def result(file_id, line, hours, error):
    return event(file_id, line, hours, "tool_result", is_error=error)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, SE.ROCKSDB)
    yield
    spark.conf.set(key, before)


def test_streaming_episodes(spark, tmp_path, rocksdb):
    """Lines of two files over twelve batches, out of order, repeated, late; equal to the batch table, with an empty state at the end."""
    lines = []
    for f, shift in (("a", 0), ("b", 5)):
        for k in range(5):  # five episodes of twelve lines, a day apart
            h, n = 24 * k + shift, 100 * k
            lines += [prompt(f, n, h, k % 2 == 1), tokens(f, n + 1, h + .01), call(f, n + 2, h + .02, "x.py"), call(f, n + 3, h + .03, "x.py"),
                      result(f, n + 4, h + .03, True), result(f, n + 5, h + .04, True), call(f, n + 6, h + .05, "y.py", False),
                      result(f, n + 7, h + .05, k == 2), call(f, n + 8, h + .06, "x.py"), tokens(f, n + 9, h + .07, "gpt-5", 50 + k),
                      tokens(f, n + 10, h + .5), event(f, n + 11, h + .6, "label", label_field="effort", label="high")]
    lines.sort(key=lambda r: r[3])
    step = len(lines) // 10
    batches = [lines[i:i + step] for i in range(0, len(lines), step)]
    for i in range(0, len(batches) - 1):  # a line moves to the next batch, another one is repeated there
        batches[i + 1] += [batches[i].pop(3), batches[i][0]]
    late = event("a", 1, 0.005, "compaction")  # after five days of other lines
    batches.append([late, event("clock", 1, 24 * 90, "touch")])
    path, schema = landed(spark, tmp_path, batches, 86_400, EV)
    out = f"{tmp_path}/out"
    stream = SE.stream_episodes(SL.on_time(spark, path, schema, 1), 300, 10 * 86_400, "2 days")
    progress = SW.append(stream, out, f"{tmp_path}/cp3")
    assert len(progress) >= 10 and SW.dropped_rows(progress) == 0
    cols = ["file_id", "ep", "start_seq", "start_ts", "last_ts", "total", "nano", "model", "effort", "tool_calls", "reads", "edits", "files_touched",
            "max_edits_per_file", "errors", "error_run", "quiet_run", "active_ms", "compacted", "end_type", "task_type", "edit_ring", "error_dense", "no_progress"]
    got = sorted(map(tuple, spark.read.parquet(out).select(cols).collect()))
    want = E.raw_episodes(as_ev(spark.createDataFrame(lines, EV))).select(cols)
    assert got == sorted(map(tuple, want.collect())) and len(got) == 10
    assert [r.seq for r in SL.late_records(spark, path, schema).collect()] == [STRIDE]
    assert sum(s["numRowsTotal"] for s in progress[-1]["stateOperators"]) < SW.largest_state(progress)


def test_landed_batch_is_one_step(spark, tmp_path):
    """A batch of several files, one longer than the operators wait, is read in one step; a batch of one row too."""
    batches = [[usage(i, 6 * i) for i in range(40)], [usage(50, 24 * 10)], [usage(99, 24 * 90)]]
    path = f"{tmp_path}/landed"
    SL.land(source(spark, tmp_path, batches, USAGE), path, f"{tmp_path}/cp", 86_400, files=3)
    schema = spark.createDataFrame([], USAGE).schema
    for n in range(3):
        assert len(spark.read.schema(schema).parquet(f"{path}/on_time/batch={n}").inputFiles()) == 3
    out = f"{tmp_path}/out"
    progress = SW.append(SW.usage_by_day(SL.on_time(spark, path, schema, 3), None, "2 days"), out, f"{tmp_path}/cp3")
    assert [p["numInputRows"] for p in progress if p["numInputRows"]] and SW.dropped_rows(progress) == 0
    assert sum(r.records for r in spark.read.parquet(out).collect()) == 41
    assert spark.read.parquet(f"{path}/late").filter("ts is null").count() == 0


def test_many_files_equal_one(spark, sf_dir, monkeypatch):
    """The stream queries give the same rows when an arrival is dealt over several files."""
    from sessionloom.plans import stream_queries as Q
    from sessionloom.plans.catalog import QUERIES
    names = ["r1_late_records", "r2_stream_usage_by_hour"]
    one = [sorted(map(tuple, QUERIES[n](spark, sf_dir).collect())) for n in names]
    monkeypatch.setattr(Q, "FILE_ROWS", 100)
    again = f"{sf_dir}/"  # another folder to the plan cache
    assert Q._landed(spark, again)[2] > 1
    assert [sorted(map(tuple, QUERIES[n](spark, again).collect())) for n in names] == one


class Counted:
    """A state variable in memory that counts its accesses."""

    def __init__(self):
        self.value, self.calls = None, 0

    def __getattr__(self, name):
        self.calls += 1
        return {
            "exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v),
            "put": lambda v: setattr(self, "value", v), "clear": lambda: setattr(self, "value", None),
            "iterator": lambda: iter(sorted((self.value or {}).items())), "removeKey": lambda k: self.value.pop(k),
            "updateValue": lambda k, v: setattr(self, "value", {**(self.value or {}), k: v})}[name]


def test_state_accesses_do_not_grow_with_rows():
    from pyspark.sql import Row
    states = {n: Counted() for n in ("open", "waiting", "files", "models")}

    class Handle:
        getValueState = getMapState = getListState = staticmethod(lambda name, *schema: states[name])
        registerTimer = deleteTimer = staticmethod(lambda ms: None)

    class Times:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    blank = {f.split()[0]: (f.split()[1] == "bigint" and 0) for f in SE.ROW.split(", ")}
    lines = [Row(**{**blank, "seq": i, "us": i * 1_000_000, "boundary": i == 0, "platform": "A", "session_id": "s", "repo": "r", "facet": "file",
                    "facet_key": f"x{i % 7}.py", "call": True, "is_edit": True, "edits": 1}) for i in range(900)]
    processor = SE.EpisodeProcessor(300, 86_400)
    processor.init(Handle)
    assert list(processor.handleInputRows(("f",), iter(lines), Times(500_000))) == []
    assert sum(s.calls for s in states.values()) < 20
    closed, = processor.handleInputRows(("f",), iter([]), Times(10 ** 9))
    assert (closed.edits, closed.files_touched, closed.max_edits_per_file) == (900, 7, 129)
    assert all(s.value is None for s in states.values()) and sum(s.calls for s in states.values()) < 40


def test_files_of_spread_rows_need_no_shuffle(spark, tmp_path):
    """Rows that lie in enough tasks are written where they are; the number of files is exact all the same."""
    ids = spark.range(0, 400, 1, 8)
    SL.write_files(ids, f"{tmp_path}/four", 4)
    parts = [sorted(r.id for r in spark.read.parquet(f).collect()) for f in spark.read.parquet(f"{tmp_path}/four").inputFiles()]
    assert sorted(len(p) for p in parts) == [100] * 4 and sorted(sum(parts, [])) == list(range(400))
    assert all(p == list(range(p[0], p[0] + 100)) for p in parts)  # neighbours stay together
    SL.write_files(ids.coalesce(1), f"{tmp_path}/dealt", 4)
    assert len(spark.read.parquet(f"{tmp_path}/dealt").inputFiles()) == 4
    assert max(spark.read.parquet(f).count() for f in spark.read.parquet(f"{tmp_path}/dealt").inputFiles()) < 400


def test_state_partitions_follow_the_cores(spark, tmp_path, monkeypatch):
    """A query's stream opens two state stores a core and step, however many partitions the session shuffles into."""
    seen = []
    plain = SW.append
    monkeypatch.setattr(SW, "append", lambda *args: seen.extend(plain(*args)))
    folder = f"{tmp_path}/in"
    spark.createDataFrame([usage(0, 1), usage(1, 10), usage(9, 24 * 30)], USAGE).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(USAGE).parquet(folder)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = stream_queries.appended(spark, SW.usage_by_hour(stream)).collect()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(r.tokens for r in got) == [1, 2]
    assert {s["numShufflePartitions"] for p in seen for s in p["stateOperators"]} == {2 * spark.sparkContext.defaultParallelism}
