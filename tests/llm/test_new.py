"""Exact duplicates, periodic runs and whitening: against brute force, SQL and numpy, and odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

import __spark_entry__ as entry
from sessionloom.llm import op11_exact, op12_runs, op13_whitening
from sessionloom.llm.common import table

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def tuples(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# exact duplicates

@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 70_000])
def test_filter_has_no_false_negative(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(-2**63, 2**63 - 1, n))
    seed, segments, length, prints = op11_exact.build_filter(keys)
    where = seed, segments, length, np.frombuffer(prints, np.uint8)
    assert op11_exact.in_filter(keys, *where).all()
    assert op11_exact.in_filter(rng.integers(-2**63, 2**63 - 1, 50_000), *where).mean() < 0.01
    assert len(prints) <= max(64, 1.5 * n)


def test_exact_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = sorted(con.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()['op11_exact_dedup']})").fetchall(), key=repr)
    assert tuples(entry.queries()["op11_exact_dedup"](spark, sf_dir), *cols) == want


def exact_truth(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    out = []
    for i, t in rows:
        own = groups[SPACE.sub(" ", t or "")]
        keep = min((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), keep is None or i == keep))
    return sorted(out, key=repr)


@pytest.mark.parametrize("held", [1 << 24, 8])
def test_bytes_decide_where_digests_collide(spark, monkeypatch, held):
    """Sixteen digests for some fifty texts, in three batches, with copies in all of them and a hot text."""
    monkeypatch.setattr(op11_exact, "HELD", held)
    random.seed(5)
    rows = [(i if i % 10 else None, random.choice(["hot text", "hot\t text", "", None, " ", "a b", *[f"t {k}" for k in range(40)]])) for i in range(600)]
    rows += [(7, rows[7][1]), (8, "another text under a known id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = [docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 = 1"), docs.where("doc_id % 3 = 2 or doc_id is null")]
    weak = op11_exact.arrivals(parts, lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1))
    assert tuples(weak, "doc_id", "keep_id", "group_size", "kept") == exact_truth(rows)


def test_false_hits_join_nothing(spark, monkeypatch):
    """With filters that hit always, the byte check alone decides."""
    old = op11_exact.snapshot(spark.createDataFrame([(i, f"old {i}") for i in range(50)] + [(50, "both")], "doc_id long, text string"))
    new = op11_exact.snapshot(spark.createDataFrame([(100 + i, f"new {i}") for i in range(50)] + [(200, "both"), (201, "both")], "doc_id long, text string"))
    assert op11_exact.screen(new, old).count() < 6
    monkeypatch.setattr(op11_exact, "screen", lambda batch, old: batch.texts.select("digest").distinct())
    assert tuples(op11_exact.matches(new, old), "new_id", "new_n", "old_id", "old_n") == [(200, 2, 50, 1)]


def test_snapshots_move_texts_once(spark, capsys):
    old = op11_exact.snapshot(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    new = op11_exact.snapshot(spark.createDataFrame([(2, "a")], "doc_id long, text string"))
    op11_exact.matches(new, old).explain()
    plan = capsys.readouterr().out
    assert all("text#" not in line for line in plan.splitlines() if "Exchange" in line)


def test_exact_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    early = F.coalesce(F.col("doc_id") < 5, F.lit(False))
    out = op11_exact.arrivals([odd_docs.where(early), odd_docs.where(~early)])
    assert tuples(out, "doc_id", "keep_id", "group_size", "kept") == exact_truth(rows)
    assert op11_exact.arrivals([no_docs, no_docs]).count() == 0
    assert op11_exact.arrivals([no_docs, odd_docs]).count() == len(rows)


# periodic runs

def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(all(words[k] == words[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_row(words):
    runs = brute_runs(words)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    s, m, q = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
    return (len(runs), s, m, q, 1000 * m // q if runs else None, hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest())


def test_runs_against_brute_force():
    random.seed(3)
    for _ in range(400):
        texts = []
        for _ in range(random.randint(1, 6)):
            n, k = random.randint(0, 110), random.randint(1, 4)
            w = [b"%d" % random.randrange(k) for _ in range(n)]
            if n and random.random() < .6:
                a, p = random.randrange(n), random.randint(1, max(1, n // 3))
                w = [w[i] if i < a or a + (i - a) % p >= n else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        assert [r[:7] for r in op12_runs._block(texts, False)] == [run_row(w) for w in texts]


def test_long_period_and_thue_morse():
    base = [b"w%d" % i for i in range(5000)]
    row = op12_runs._block([base * 4 + base[:17], [b"%d" % (bin(i).count("1") % 2) for i in range(4096)]], True)
    assert row[0][:5] == (1, 0, 20_017, 5000, 4003) and row[0][7] == b" ".join(base).decode()
    assert row[1][0] == 0


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    values = rng.permutation(700)
    tree = op12_runs.WaveletTree(values)
    low = rng.integers(0, 700, 300)
    high = np.minimum(low + 1 + rng.integers(0, 200, 300), 700)
    at = rng.integers(0, 700, 300)
    assert tree.below(low, high, at).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(low, high, at)]
    nth = rng.integers(0, high - low)
    assert tree.nth(low, high, nth).tolist() == [int(np.sort(values[a:b])[k]) for a, b, k in zip(low, high, nth)]


def test_runs_query(spark, sf_dir):
    """Small documents of the given table by brute force, edit and all."""
    rows = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in entry.queries()["op12_periodic_runs"](spark, sf_dir).collect()}
    assert set(got) == set(rows)
    edited = 0
    for doc_id, text in rows.items():
        words = [w for w in SPACE.split(text) if w]
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            edited += 1
        if len(words) <= 400:
            assert got[doc_id] == run_row([w.encode() for w in words])
    assert edited > 5


def test_runs_odd_rows(spark, odd_docs, no_docs):
    out = op12_runs.periodic_runs(odd_docs, op12_runs.repeat_tail, collapsed=True)
    assert out.count() == odd_docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert {tuple(r)[1:8] for r in out.where("doc_id in (1, 2, 3)").collect()} == {(0, None, None, None, None, empty, empty)}
    assert out.where("doc_id = 0").distinct().count() == 1
    assert op12_runs.periodic_runs(no_docs).count() == 0


# whitening

def test_whitening_against_numpy(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect() if r.embedding is not None]
    rows = [(i, v) for i, v in rows if all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(1024 * np.asarray([v for _, v in rows], float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    y = (n * x - sums) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    out = entry.queries()["op13_embedding_whitening"](spark, sf_dir).toPandas()
    assert len(out) == 8 * n and (out.n == n).all() and out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9
    got = out.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    want = y @ u[:, :8] / np.sqrt(e[:8])
    want *= np.sign((want * got).sum(0))
    assert np.abs(got - want).max() < 1e-8
    first = out[out.component == 1].set_index("vec_id")
    assert first.deviation.loc[[i for i, _ in rows]].tolist() == [sum(int(c) ** 2 for c in r) for r in n * x - sums]
    share = out.groupby("component").explained.first().to_numpy()
    assert np.abs(share / (e[:8] / e.sum()) - 1).max() < 1e-9


def vectors(spark, rows):
    return spark.createDataFrame([(v,) for v in rows], "v array<double>")


def test_ill_conditioned_vectors(spark):
    """Spreads over seven decades, where one Cholesky factor of the Gram matrix would lose the small ones."""
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    rows = (rng.normal(size=(3000, 6)) * [3e5, 1e4, 100, 3, .1, .02]) @ turn
    w = op13_whitening.fit(vectors(spark, rows.tolist()))
    x = np.floor(1024 * rows) + 100_000
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert np.allclose(np.sqrt(w.values * 3000) / s, 1, rtol=1e-7)
    assert op13_whitening.identity_error(vectors(spark, rows.tolist()), w, 6) < 1e-6


def test_dependent_and_constant_dimensions(spark):
    rng = np.random.default_rng(4)
    w = op13_whitening.fit(vectors(spark, [[a, a, 1.0, b, -a] for a, b in rng.integers(-50, 50, (200, 2)).astype(float).tolist()]))
    assert len(w.values) == 2 and np.abs(w.vectors[2]).max() == 0
    assert np.allclose(np.ptp(np.abs(w.vectors[[0, 1, 4]]), axis=0), 0, atol=1e-9)


def test_whitening_odd_rows(spark, tmp_path):
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("whitened", T.StringType())])
    good = [(None, [1.0, 2.0], "x"), (1, [3.0, -1.0], "x"), (1, [3.0, -1.0], None), (2, [0.5, 0.25], "x")]
    odd = [(3, None, "x"), (4, [], "x"), (5, [1.0, None], "x"), (6, [1.0, float("nan")], "x"), (7, [float("inf"), 1.0], "x")]
    for name, rows in (("some", good + odd), ("none", odd), ("same", good[1:3])):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    query = entry.queries()["op13_embedding_whitening"]
    out = query(spark, f"{tmp_path}/some")
    assert sorted((r.vec_id is None, r.vec_id, r.component) for r in out.where("vec_id is not null").collect()) == [
        (False, 1, 1), (False, 1, 1), (False, 1, 2), (False, 1, 2), (False, 2, 1), (False, 2, 2)]
    assert out.where("vec_id is null").count() == 2
    assert query(spark, f"{tmp_path}/none").count() == 0 and query(spark, f"{tmp_path}/same").count() == 0
    with pytest.raises(Exception, match="several lengths"):
        op13_whitening.fit(vectors(spark, [[1.0], [1.0, 2.0]]))


def test_large_deviations_stay_exact(spark):
    rows = spark.createDataFrame([(i, [1e9 * (-1) ** i, float(i)]) for i in range(40)], "vec_id long, embedding array<double>")
    w = op13_whitening.fit(rows.select("embedding"))
    got = {r.vec_id: int(r.deviation) for r in op13_whitening.whiten(rows, w, 1).collect()}
    x = [[int(1024 * 1e9 * (-1) ** i) + 100_000, 1024 * i + 100_000] for i in range(40)]
    sums = [sum(c) for c in zip(*x)]
    assert got == {i: sum((40 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(x)}
