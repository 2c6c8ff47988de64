"""Tables that grow with the input go through no broadcast, whatever size Spark guesses for them."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import Row, functions as F

from sessionloom.llm import common, op6_suffix, op10_minhash
from sessionloom.operators.scan import following, last_before, ordered_scan, running_sum
from sessionloom.operators.sessions import session_candidates_b
from sessionloom.session import stage
from sessionloom.sources import logs as L, normalize_b as NB
from sessionloom.streaming import episodes as SE

RAW = "file_id string, line_no bigint, value string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def record(kind, **payload):
    return json.dumps({"type": kind, "timestamp": "2024-03-01T10:00:00Z", "payload": payload})


def raw_b(spark):
    use = {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 5, "output_tokens": 2}}}
    call = {"type": "function_call", "name": "shell", "call_id": "c", "arguments": "{}"}
    out = {"type": "function_call_output", "call_id": "c", "output": "{\"metadata\":{\"exit_code\":1},\"output\":\"boom\"}"}
    rows = []
    for f, source in (("main", "vscode"), ("sub", "subagent-x")):
        rows += [(f, 0, record("event_msg", **use)), (f, 1, record("session_meta", id=f, cwd="/w/p", source=source)),
                 (f, 2, record("event_msg", **use)), (f, 3, record("response_item", **call)), (f, 4, record("response_item", **out))]
    return spark.createDataFrame([*rows, (None, 0, record("event_msg", **use)), ("none", 0, record("event_msg", **use))], RAW)


def test_scan_without_broadcast(spark):
    rows = [("a", 0, 1), ("a", 5, 2), ("a", 9, 4), ("b", 3, 8), (None, 1, 16), (None, 6, 32), ("a", None, 64)]
    df = spark.createDataFrame(rows, "k string, pos bigint, v bigint")
    specs = [running_sum("s", F.col("v")), last_before("l", F.col("v")), following("n", F.col("v"))]
    keys = spark.createDataFrame([("a", "x"), (None, "y"), ("c", "z")], "k string, label string")
    base = ordered_scan(df, ["k"], "pos", specs, 4)
    assert "Broadcast" not in plan(base)
    more = ordered_scan(df, ["k"], "pos", specs, 4, keys)
    assert "Broadcast" not in plan(more)
    assert more.columns == ["k", "pos", "v", "s", "l", "n", "label"]
    got = {tuple(r) for r in more.collect()}
    # null keys are one key of the scan, but match no row of another table
    assert got == {(*r, "x" if r[0] == "a" else None) for r in map(tuple, base.collect())} and len(got) == 7
    # a row without a position comes first
    assert {("a", 9, 4, 71, 2, None, "x"), ("a", None, 64, 64, None, None, "x"), (None, 6, 32, 48, 16, None, None)} <= got


def test_normalize_b_without_broadcast(spark):
    good, _ = L.parse_json(raw_b(spark))
    carried = NB.carried_records(good)
    assert "Broadcast" not in plan(carried)
    side = {(r.file_id, r.seq): r.is_sidechain for r in carried.collect()}
    # also the rows before a file's header know its kind
    assert side == {**{("main", i): False for i in range(5)}, **{("sub", i): True for i in range(5)}, (None, 0): False, ("none", 0): False}
    ev = NB.normalize_b(good)
    assert "Broadcast" not in plan(ev)
    rows = ev.filter("file_id = 'main' and kind = 'tool_result'").select("tool_name", "is_error").collect()
    assert [tuple(r) for r in rows] == [("shell", True)]
    assert ev.filter("kind = 'tokens'").count() == 6


def test_candidates_b_without_broadcast(spark):
    good, _ = L.parse_json(raw_b(spark))
    facts = NB.session_facts(good)
    assert "Broadcast" not in plan(facts)
    found = session_candidates_b(stage(NB.normalize_b(good), "ev-b"), facts)
    assert "Broadcast" not in plan(found)
    got = {(r.file_id, r.source, r.tokens, r.tool_calls, r.shell_calls) for r in found.collect()}
    assert got == {("main", "plugin", 14, 1, 1), ("none", None, 7, 0, 0), (None, None, 7, 0, 0)}


class Entry:
    """A state variable in memory that counts its accesses and knows its largest value."""

    def __init__(self):
        self.value, self.calls, self.largest = {}, 0, 0

    def updateValue(self, key, value):
        self.calls, self.value[key], self.largest = self.calls + 1, value, max(self.largest, len(value[0]))

    def removeKey(self, key):
        self.calls += 1
        del self.value[key]

    def iterator(self):
        self.calls += 1
        return iter(self.value.items())

    def clear(self):
        self.calls += 1
        self.value = {}

    def get(self):
        self.calls += 1
        return self.value.get(())

    def update(self, value):
        self.updateValue((), value)


@pytest.mark.parametrize("part", [4 << 20, 1_000])
def test_files_share_state_accesses(monkeypatch, part):
    """Many files of few lines are read and written together, in entries of bounded size, and closed each by itself."""
    monkeypatch.setattr(SE, "PART", part)
    states, timers = {}, set()

    class Handle:
        getValueState = getMapState = staticmethod(lambda name, *schema: states.setdefault(name, Entry()))
        registerTimer, deleteTimer = staticmethod(timers.add), staticmethod(timers.remove)

    class Times:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    blank = {f.split()[0]: (f.split()[1] == "bigint" and 0) for f in SE.ROW.split(", ")}

    def line(f, i, us):
        return Row(**{**blank, "file_id": f"f{f}", "seq": i, "us": us, "boundary": i == 0, "platform": "A", "session_id": f"s{f}", "repo": "r",
                      "facet": "file", "facet_key": f"x{i}.py", "call": True, "is_edit": True, "edits": 1})

    processor, closed = SE.EpisodeProcessor(300, 86_400), []
    processor.init(Handle)
    for i in range(3):  # the files begin a minute after one another
        closed += processor.handleInputRows((0,), iter([line(f, i, (60 * f + i) * 1_000_000) for f in range(300)]), Times(0))
    rest = states["waiting"]
    assert not closed and len(timers) == 1 and (part > 1_000) == (not rest.value)
    assert part > 1_000 or sum(e.calls for e in states.values()) < 300
    assert part < 10_000 or sum(e.calls for e in states.values()) <= 6
    assert max(e.largest for e in states.values()) <= part
    while timers:
        now, = timers
        timers.clear()
        closed += processor.handleExpiredTimer((0,), Times(now), None)
    assert sorted((r.file_id, r.edits, r.files_touched) for r in closed) == sorted((f"f{f}", 3, 3) for f in range(300))
    assert not any(e.value for e in states.values())


def test_shares_of_anchors(spark, monkeypatch):
    """Each share has its part of the places, all shares have them all, and the result doesn't depend on their number."""
    import random
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(40)]
    texts[20:] = [f"{a[:900]} {b[300:]}" for a, b in zip(texts[:20], texts[20:])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts)], ["doc_id", "text"])

    def places(*share):
        return [tuple(r.values()) for b in op6_suffix._places([batch], *share) for r in b.to_pylist()]

    every, parts = places(), [places(i, 2) for i in range(2)]
    assert sorted(sum(parts, [])) == sorted(every) and max(map(len, parts)) < .6 * len(every)
    assert not {r[0] for r in parts[0]} & {r[0] for r in parts[1]}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = []
    for n in (op6_suffix.SHARES, 1, 3):
        monkeypatch.setattr(op6_suffix, "SHARES", n)
        rows.append(sorted(tuple(r) for r in op6_suffix.remove_repeats(docs).collect()))
    assert op6_suffix.SHARES == 3 and rows[0] == rows[1] == rows[2] and sum(r[3] > 0 for r in rows[0]) >= 20


def test_stages_send_no_large_table_through_the_driver(spark, monkeypatch):
    """Below Spark's own limit a table is merged in a written stage; a small one may still be sent. The session's limits come back."""
    plans, whole = [], common._stage
    monkeypatch.setattr(common, "_stage", lambda df, name: plans.append(plan(df)) or whole(df, name))
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = [spark.conf.get(k, None) for k in keys]
    hashed = lambda n: spark.range(n).select(F.xxhash64("id").alias("id"))
    wide = hashed(200_000).withColumn("v", F.col("id") + 1)
    large, small = common.stage(hashed(100_000), "large"), common.stage(hashed(100), "small")
    plans.clear()
    assert common.stage(wide.join(large, "id"), "both").count() == 100_000 and "Broadcast" not in plans[-1]
    assert common.stage(wide.join(small, "id"), "both").count() == 100 and "BroadcastHashJoin" in plans[-1]
    assert [spark.conf.get(k, None) for k in keys] == before
    spark.conf.set(keys[0], "-1")
    try:
        assert common.stage(wide.join(small, "id"), "both").count() == 100 and "Broadcast" not in plans[-1]
    finally:
        spark.conf.unset(keys[0]) if before[0] is None else spark.conf.set(keys[0], before[0])


def test_near_duplicates_without_broadcast(spark):
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{text} end{i % 3}") for i in range(6)] + [(9, "something else that stands alone here")], "doc_id long, text string")
    out = op10_minhash.near_duplicates(docs)
    assert "Broadcast" not in plan(out)
    assert sorted((r.doc_id, r.component_id) for r in out.collect()) == [*((i, 0) for i in range(6)), (9, 9)]
