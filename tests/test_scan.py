"""The chunked scan equals plain windows at any chunk width; results do not depend on row order."""

from pyspark.sql import Window, functions as F

from sessionloom.operators import episodes as E, joins as J, tokens as T
from sessionloom.operators.scan import Running, first_seen, following, last_before, last_seen, ordered_scan, previous, quantiles, running_sum
from sessionloom.plans.adapters import events_as_ev


def test_scan_equals_window(spark):
    # One hot key holds most rows; values have nulls, positions have gaps.
    df = spark.range(400).select(
        F.when(F.col("id") % 5 == 0, F.concat(F.lit("k"), F.col("id") % 3)).otherwise(F.lit("hot")).alias("k"),
        (F.col("id") * 3).alias("pos"), F.when(F.col("id") % 4 != 1, F.col("id") % 17).alias("v"))
    v = F.col("v")
    specs = [running_sum("s", v), last_seen("l", v), last_before("b", v), first_seen("f", v), previous("p", v), following("n", v), Running("m", "max", v)]
    w = Window.partitionBy("k").orderBy("pos")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "pos", F.coalesce(F.sum(v).over(upto), F.lit(0)), F.last(v, True).over(upto), F.last(v, True).over(before),
                     F.first(v, True).over(upto), F.lag(v).over(w), F.lead(v).over(w), F.max(v).over(upto)).orderBy("pos").collect()
    for width in (1, 7, 100, 10**6):
        got = ordered_scan(df.repartition(5), ["k"], "pos", specs, width).select("k", "pos", "s", "l", "b", "f", "p", "n", "m").orderBy("pos").collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in want], width


def test_episodes_do_not_depend_on_chunks_or_order(spark, sf_dir, collect):
    ev = events_as_ev(spark, sf_dir)
    base = collect(E.episode_detail(ev, 21600))
    assert base and collect(E.episode_detail(ev.repartition(3), 21600, width=64)) == base


def delta_loop(rows):
    """Sequential reading of the counters, field by field."""
    prev, out = {}, []
    for file_id, seq, last, total in sorted(rows):
        if last is None and total is None:
            continue
        p = prev.get(file_id, 0)
        out.append((file_id, seq, last if last is not None else max(0, total - p)))
        prev[file_id] = total if total is not None else p + last
    return out


def test_token_deltas_equal_loop(spark):
    import random
    rng = random.Random(5)
    rows = [(f"f{i % 3}", i, rng.choice([None, rng.randint(1, 50)]), rng.choice([None, rng.randint(0, 300)])) for i in range(200)]
    data = []
    for f, s, last, total in rows:
        data.append((f, s, last is not None, total is not None, *[last] * 5, *[total] * 5))
    cols = "file_id string, seq bigint, has_last boolean, has_total boolean, " + ", ".join(
        f"{k}_{c} bigint" for k in ("last", "total") for c in T.COUNTERS)
    df = spark.createDataFrame(data, cols)
    want = [(f, s, d) for f, s, d in delta_loop(rows)]
    for width in (4, 1000):
        got = [(r.file_id, r.seq, r.output) for r in T.token_deltas(df, width).orderBy("file_id", "seq").collect()]
        assert got == want


def test_mixed_counter_case(spark):
    cols = "file_id string, seq bigint, has_last boolean, has_total boolean, " + ", ".join(f"{k}_{c} bigint" for k in ("last", "total") for c in T.COUNTERS)
    rows = [("f", 0, True, False, 8, 0, 2, 0, 10, *[None] * 5), ("f", 1, False, True, *[None] * 5, 12, 0, 3, 0, 15)]
    assert sum(r.total for r in T.token_deltas(spark.createDataFrame(rows, cols)).collect()) == 15


def test_hot_key_dedup(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 10 < 9, F.lit("hot")).alias("dedup_key"), F.lit("f").alias("file_id"), F.col("id").alias("seq"))
    kept = J.dedup_records(rows.repartition(6))
    assert (kept.count(), kept.filter("dedup_key = 'hot'").first().seq) == (101, 0)
    assert "WindowGroupLimit" in kept._jdf.queryExecution().toString()


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", 60)] * 9 + [("a", 400)] + [("b", 600)] * 5 + [("b", 400)], "t string, v bigint")
    for width in (10, 10**6):
        assert {r.t: r.q_value for r in E.nearest_rank(df, ["t"], "v", 0.9, width).collect()} == {"a": 60, "b": 600}


def test_quantiles_all_at_once(spark, capsys):
    """Several rules and keys, a hot value, null keys and values, any cell width; one scan, and no key's rows in one place."""
    import math
    import random
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 0, 0, 0, rng.randint(-50, 5000)])) for _ in range(700)] + [("only nulls", None)]
    df = spark.createDataFrame(rows, "k string, v bigint").repartition(4)
    picks = {"p50": ("nearest", 0.5), "p90": ("nearest", 0.9), "i95": ("index", 0.95), "top": ("nearest", 1.0)}
    want = {}
    for k in ("a", "b", None):
        v = sorted(x for key, x in rows if key == k and x is not None)
        want[k] = (len(v), v[math.ceil(.5 * len(v)) - 1], v[math.ceil(.9 * len(v)) - 1], v[min(len(v) - 1, math.floor(len(v) * .95))], v[-1])
    for width in (1, 30, 10**6):
        got = quantiles(df, ["k"], "v", picks, width)
        assert {r.k: tuple(r)[1:] for r in got.collect()} == want
    quantiles(df, ["k"], "v", picks, 30).explain()
    plan = capsys.readouterr().out
    assert plan.count("Window [sum(_n") == 1 and "CartesianProduct" not in plan
    assert quantiles(df.filter("k = 'only nulls'"), ["k"], "v", picks).count() == 0


def test_commits_in_long_and_short_sessions(spark):
    """Against every pair; a year-long session and a repository with most commits stay spread."""
    import datetime as dt
    import random
    rng = random.Random(4)
    start = dt.datetime(2023, 1, 1)
    at = lambda h: start + dt.timedelta(hours=h)
    spans = [(0, 8760), (5, 5), (10, 10.5), (0.99, 1.01), (100, 70), (30, 20_000)] + [(a, a + rng.choice([.2, 3, 60, 900])) for a in rng.sample(range(9000), 40)]
    sessions = [(i, rng.choice(["hot", "r"]), at(a), at(b)) for i, (a, b) in enumerate(spans)]
    commits = [(f"c{i}", "hot" if i % 10 else "r", at(rng.uniform(0, 9500))) for i in range(600)] + [("edge", "hot", at(0)), ("edge", "r", at(0)), ("late", "hot", at(30_000))]
    left = spark.createDataFrame(sessions, "s int, repo string, first_ts timestamp_ntz, last_ts timestamp_ntz")
    right = spark.createDataFrame(commits, "c string, repo string, commit_ts timestamp_ntz")
    joined = J.commits_in_session(left, right)
    want = sorted((s, c) for s, r, a, b in sessions for c, q, t in commits if r == q and a <= t <= b)
    assert sorted((r.s, r.c) for r in joined.select("s", "c").collect()) == want and joined.columns == ["repo", "s", "first_ts", "last_ts", "c", "commit_ts"]
    assert J.commits_in_session(left.limit(0), right).count() == 0


def test_scan_shuffles_rows_once(spark, capsys):
    """Windows and join share one key: the rows are shuffled once, their chunk summaries three times."""
    rows = spark.createDataFrame([(None, 1, 2), ("a", 3, 4), (None, 9, 5)], "k string, n bigint, v bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ordered_scan(rows, ["k"], "n", [running_sum("s", F.col("v"))], 4)
        out.explain()
        plan = capsys.readouterr().out
        assert sorted(map(tuple, out.collect()), key=repr) == [("a", 3, 4, 4), (None, 1, 2, 2), (None, 9, 5, 7)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 4


def test_unpriced_set_reads_once(spark, sf_dir, capsys):
    """One pass over the events, and prices are looked up after the sums."""
    from sessionloom.plans.catalog import QUERIES
    QUERIES["u4_unpriced_set"](spark, sf_dir).explain()
    assert capsys.readouterr().out.count("FileScan") == 1
