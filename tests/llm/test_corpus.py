"""Quality, repeats, decontamination, near duplicates and the pipeline against brute force, and odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sessionloom.llm import op1_quality, op6_suffix, op8_decontam, op10_minhash
from sessionloom.llm.common import stage, table
from sessionloom.llm.components import connected_components

SMALL = "/root/testdata/sf0.01"


def test_all_queries_are_registered():
    names = {re.match(r"op\d+_|pipeline", n)[0] for n in entry.queries() if re.match(r"op\d+_|pipeline$", n)}
    assert names == {f"op{n}_" for n in range(1, 14)} | {"pipeline"}


def test_chat_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["op5_chat_format"]).fetchall())
    assert sorted(map(tuple, entry.queries()["op5_chat_format"](spark, sf_dir).collect())) == want


# quality

def test_model_is_kneser_ney(spark):
    """Against a direct evaluation of the interpolated formula on a small text."""
    texts = ["the cat sat on the mat and the dog sat on the log", "a dog and a cat and a bat"]
    level, below = op1_quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    p = {g: v for r in level.collect() for g, v in zip(r.grams, r.p)}
    tri = Counter(t.encode()[i:i + 3] for t in texts for i in range(len(t) - 2))
    bi, uni = Counter(g[1:] for g in tri), Counter()
    for g in bi:
        uni[g[1:]] += 1

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        if 0 in n:
            return [0.5, 0.75, 0.9]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]

    d3, d2, d1 = discounts(tri), discounts(bi), discounts(uni)
    cut = lambda n, d: d[min(n, 3) - 1] if n else 0
    total = sum(uni.values())
    one = {b: max(uni[bytes([b])] - cut(uni[bytes([b])], d1), 0) / total for b in range(256)}
    rest = 1 - sum(one.values())

    def two(g):
        own = {h: n for h, n in bi.items() if h[:1] == g[:1]}
        t = sum(own.values())
        lower = one[g[1]] + rest / 256
        return lower if not t else (own.get(g, 0) - cut(own.get(g, 0), d2)) / t + sum(cut(n, d2) for n in own.values()) / t * lower

    for g, n in tri.items():
        own = {h: k for h, k in tri.items() if h[:2] == g[:2]}
        t = sum(own.values())
        want = (n - cut(n, d3)) / t + sum(cut(k, d3) for k in own.values()) / t * two(g[1:])
        assert math.isclose(p[int.from_bytes(g, "big")], want, rel_tol=1e-9)
    assert np.allclose(below.reshape(256, 256).sum(1), 1)


def test_quality_labels(spark):
    got = op1_quality.op1_quality(spark, SMALL).join(table(spark, SMALL, "labels"), "doc_id").collect()
    assert sum(r.kept for r in got if r.quality == 1) >= 0.98 * sum(r.quality == 1 for r in got)
    assert sum(r.kept for r in got if r.quality == 0) <= 0.3 * sum(r.quality == 0 for r in got)


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (4, 1), (1, 1), (None, 1), (6, None)], "doc_id long, quality int")
    got = op1_quality.classify(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(r.kept for r in got if r.perplexity is None)
    assert all(r.kept for r in op1_quality.classify(odd_docs, labels.limit(0)).collect())
    assert op1_quality.classify(no_docs, labels).count() == 0


# repeats

@pytest.mark.parametrize("n, letters", [(1, 3), (2, 2), (300, 2), (500, 4), (200, 1), (2000, 3)])
def test_suffix_order(n, letters):
    rng = np.random.default_rng(n)
    text = rng.integers(97, 97 + letters, n).astype(np.uint8)
    if n == 500:
        text[100:180] = text[300:380]
    order, raw = op6_suffix.suffix_order(text), text.tobytes()
    keys = [raw[i:i + 50].ljust(50, b"\0") for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(n))
    lcp = op6_suffix.common_prefixes(text, order)
    for i in range(1, n):
        a, b = keys[i - 1], keys[i]
        assert lcp[i] == next((k for k in range(50) if a[k] != b[k]), 50)


def _without_repeats(docs):
    seen, out = {}, {}
    for i, text in docs:
        raw = text.encode()
        gone = np.zeros(len(raw) + 1, int)
        own = []
        for p in range(len(raw) - 49):
            s = raw[p:p + 50]
            if s in seen:
                gone[p] += 1
                gone[p + 50] -= 1
            else:
                own.append(s)
        seen.update((s, i) for s in own)
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("together", [4096, 1])
def test_repeats(spark, sf_dir, monkeypatch, together):
    monkeypatch.setattr(op6_suffix, "TOGETHER", together)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op6_suffix.op6_suffix_dedup(spark, sf_dir).collect()}
    assert got == _without_repeats(sorted((r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()))


def test_repeats_odd_rows(spark, odd_docs, no_docs):
    got = op6_suffix.remove_repeats(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[4].n_removed == 0 and by[5].n_removed == by[4].n_bytes and bytes(by[5].kept) == b" end"[-4:]
    assert by[0].n_removed == 0 and by[1].n_bytes == 0 and by[None].n_removed == 0
    assert op6_suffix.remove_repeats(no_docs).count() == 0
    assert op6_suffix.without_repeats(odd_docs).columns == odd_docs.columns


# decontamination

def test_decontamination(spark):
    items = table(spark, SMALL, "benchmark").collect()
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    grams = {tuple(w[i:i + 13]) for x in items for w in [words(x.text)] for i in range(len(w) - 12)}
    docs = table(spark, SMALL, "documents").collect()
    exact = {x.doc_id for x in docs for w in [words(x.text)] if any(tuple(w[i:i + 13]) in grams for i in range(len(w) - 12))}
    got = {r.doc_id for r in op8_decontam.op8_decontamination(spark, SMALL).collect() if r.contaminated}
    assert exact <= got and len(got - exact) <= 3


def test_decontamination_substitutions(spark):
    item = " ".join(f"t{i}" for i in range(30))
    for step in (7, 11):
        other = " ".join("zz" if i % step == 3 else f"T{i}" for i in range(30))
        docs = spark.createDataFrame([(1, "before it " * 20 + other + " after it" * 20), (2, "something else " * 40), (3, " ".join(f"t{i}" for i in range(8)))], "doc_id long, text string")
        got = op8_decontam.overlaps(docs, spark.createDataFrame([(9, item), (10, item), (11, "t1 t2"), (None, None)], "item_id long, text string")).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(1, 9), (1, 10)}


def test_decontamination_behind_the_first_hit(spark):
    """Long verbatim remains count when the first hit, or several, stand in edited parts of the same passage."""
    edited = lambda k: [f"z{k}z{i}" if i in (2, 5, 6, 8) else f"t{k + i}" for i in range(10)]
    near = edited(0) + [f"u{i}" for i in range(20)] + [f"t{i}" for i in range(30, 60)]
    far = [w for k in (0, 50, 100) for w in edited(k) + [f"u{k}u{i}" for i in range(40)]] + [f"t{i}" for i in range(150, 200)]
    docs = spark.createDataFrame([(1, " ".join(near)), (2, "before it " + " ".join(far) + " after it")], "doc_id long, text string")
    for doc, n, size, at in ((1, 60, 30, 30), (2, 200, 50, 152)):
        items = spark.createDataFrame([(9, " ".join(f"t{i}" for i in range(n)))], "item_id long, text string")
        got = [tuple(r) for r in op8_decontam.overlaps(docs.where(F.col("doc_id") == doc), items).collect()]
        assert got == [(doc, 9, size, at)]


@pytest.mark.parametrize("seed", range(5))
def test_best_stretch(seed):
    rng = np.random.default_rng(seed)
    for n in range(10, 60):
        equal = rng.random(n) < (0.9, 0.8, 0.7, 0.6, 0.5)[seed]
        hits = np.flatnonzero(equal[:n - 9])[::5]
        if len(hits):
            want = max([int(equal[l:r].sum()) for l in range(n) for r in range(l + 1, n + 1)
                        if 5 * equal[l:r].sum() >= 4 * (r - l) and any(l <= h and h + 10 <= r for h in hits)], default=0)
            assert op8_decontam._best(equal, hits)[0] == want


def test_decontamination_looks_up_few_characters(spark):
    """Ranges rule out most characters before their script and category are looked up; on all characters the words are the same."""
    assert op8_decontam.BETWEEN.startswith(r"[[^\x00-\x7F]&&") and op8_decontam.UNSPACED.startswith(r"([[^\x00-\x{DFF}]&&")
    every = [(c, f"a{chr(c)}b") for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame(pd.DataFrame(every, columns=["c", "text"]), "c int, text string")
    between = r"[[\p{P}\p{S}\p{Z}]&&[^\x00-\x7F]]"
    scripts = "|".join(rf"\p{{Is{s}}}" for s in ("Han", "Hiragana", "Katakana", "Bopomofo", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))
    plain = F.regexp_replace(F.regexp_replace(F.lower("text"), between, " "), f"({scripts})", " $1 ")
    assert rows.where(~plain.eqNullSafe(op8_decontam._spaced("text"))).count() == 0


def test_decontamination_short_and_unspaced_items(spark):
    """Short items stand as whole word sequences; characters of unspaced scripts are words, and their punctuation separates."""
    chinese = "".join(chr(0x4E00 + 37 * k % 3000) for k in range(55))
    items = spark.createDataFrame(
        [(1, "What is the capital of France?"), (2, chinese), (3, "one two three four"), (4, "name the five largest lakes here")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "We ask: what is the capital of france, and go on."), (2, "What is the old capital of France?"), (3, "前文。" + chinese + "。后文"),
        (4, "".join(chr(0x4E00 + 41 * k % 3000 + 7) for k in range(80))), (5, "what is the capital of france"), (6, "one two three four five"),
        (7, "what is the capital of"), (8, chinese[:30] + "\u3001" + chinese[30:]), (9, "“Name the five largest lakes”… here")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_equal for r in op8_decontam.overlaps(docs, items).collect()}
    assert got == {(1, 1): 6, (5, 1): 6, (3, 2): 55, (8, 2): 55, (9, 4): 6}


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs away from all of them today"), (1, None), (None, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in op8_decontam.overlaps(odd_docs, items).collect()} == {(0, 1)}
    assert op8_decontam.overlaps(no_docs, items).count() == 0 and op8_decontam.overlaps(odd_docs, items.limit(0)).count() == 0


# near duplicates

def _components(docs, percent=85):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    inverted = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        shared = Counter(j for x in s for j in inverted[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op10_minhash.op10_minhash_dedup(spark, SMALL).collect()}
    assert got == _components([(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()])


def test_large_groups(spark, monkeypatch):
    """Nodes above the limit branch and meet pivots; the result stays that of the exhaustive comparison."""
    monkeypatch.setattr(op10_minhash, "LEAF", 40)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        w = [f"w{k}" for k in range(300)]
        for k in rng.integers(0, 300, rng.integers(0, 6)):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, "a common line of some words here " + " ".join(f"y{i}_{k}" for k in range(8))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op10_minhash.near_duplicates(docs).collect()}
    assert got == _components(rows)


@pytest.mark.parametrize("percent, sketch", [(80, 2048), (80, 64), (85, 64)])
def test_limits_and_sketches(spark, monkeypatch, percent, sketch):
    """Texts on both sides of the limit; with a small sketch most pairs are decided by estimates and whole sets."""
    monkeypatch.setattr(op10_minhash, "SKETCH", sketch)
    rng = np.random.default_rng(percent)
    rows = []
    for f in range(60):
        base = [f"f{f}_{k}" for k in range(int(rng.integers(5, 400)))]
        for i in range(8):
            w = list(base)
            for k in rng.choice(len(w), int(len(w) * rng.uniform(0, 0.03)), False):
                w[k] = f"x{f}_{i}_{k}"
            rows.append((10 * f + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op10_minhash.near_duplicates(docs, percent).collect()}
    assert got == _components(rows, percent)


def _two_families(members, bridges, seed):
    """Two families of near copies at about 0.83 of each other; only their first ``bridges`` members link, at 0.86."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in range(604)]
    other = list(base)
    for k in range(30, 570, 60):
        other[k] = f"v{k}"
    rows = []
    for i in range(members):
        for f, words in enumerate((base, other)):
            w = list(words)
            k = 300 * f + 60 * int(rng.integers(0, 5)) + int(rng.integers(0, 20))
            w[k] = f"x{f}_{i}_{k}"
            if i < bridges:  # one step towards the other family from either side
                w[30 if f else 90] = (base if f else other)[30 if f else 90]
            rows.append((2 * i + f, " ".join(w)))
    return rows


def test_links_behind_rejected_ones(spark):
    """Few true links between two families, among many pairs that look as alike by their estimates."""
    rows = [(1000 * k + i, f"s{k}" + text.replace(" ", f" s{k}")) for k in range(8) for i, text in _two_families(60, 2, k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op10_minhash.near_duplicates(docs).collect()}
    want = _components(rows)
    assert len({c for _, c in want.values()}) == 8
    assert got == want


def test_partners_of_classes_that_leave(spark, monkeypatch):
    """A text close to members of a large family, but not to its pivots, is linked as the exhaustive comparison links it."""
    monkeypatch.setattr(op10_minhash, "LEAF", 20)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):  # members have three own edits each, so any two lie at about 0.9
        w = [f"w{k}" for k in range(604)]
        for k in rng.choice(60, 3, False):
            w[10 * k + 2] = f"x{i}_{k}"
        rows.append((i, w))
    for i in range(60):  # a member with ten more edits: at 0.85 or more of that member only
        w = list(rows[i][1])
        for k in rng.choice(60, 9, False):
            w[10 * k + 7] = f"y{i}_{k}"
        rows.append((1000 + i, w))
    rows = [(i, " ".join(w)) for i, w in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op10_minhash.near_duplicates(docs).collect()}
    assert got == _components(rows)


def test_near_duplicates_odd_rows(spark, odd_docs, no_docs):
    got = op10_minhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[5].component_id == 4 and by[9].component_id == 8 and by[1].n_shingles == 0 and by[1].kept and by[6].n_shingles == 1
    assert op10_minhash.near_duplicates(no_docs).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = {r.id: r.label for r in connected_components(links, "a", "b").collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 102: 100}


# pipeline

def test_pipeline(spark):
    """Every stage against brute force or its operator's rows on what the stage before it kept."""
    docs = table(spark, SMALL, "documents")
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    kept = [stage(corpus_pipeline.STAGES[0][1](spark, docs, SMALL), "t")]
    for _, step in corpus_pipeline.STAGES[1:]:
        kept.append(stage(step(spark, kept[-1], SMALL), "t"))
    assert all(k.columns == docs.columns for k in kept[:-1])
    good = {r.doc_id for r in op1_quality.op1_quality(spark, SMALL).where("kept").collect()}
    assert set(texts(kept[0])) == good
    parts = _components(sorted(texts(kept[0]).items()), 80)
    assert set(texts(kept[1])) == {i for i, (_, c) in parts.items() if i == c}
    want = _without_repeats(sorted(texts(kept[1]).items()))
    for i, text in texts(kept[2]).items():
        n, removed, _, digest = want[i]
        assert removed or text == texts_of(kept[1], i, want)
        assert abs(len(text.encode()) - (n - removed)) <= 6 * want[i][2]
    bad = {r.doc_id for r in op8_decontam.overlaps(kept[2], table(spark, SMALL, "benchmark")).collect()}
    assert bad and set(texts(kept[3])) == set(texts(kept[2])) - bad
    last = {r.doc_id: r for r in kept[4].collect()}
    for i, text in texts(kept[3]).items():
        assert last[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and last[i].n_tokens == len(last[i].ids)


_cache: dict = {}


def texts_of(df, i, key):
    if id(key) not in _cache:
        _cache[id(key)] = {r.doc_id: r.text for r in df.collect()}
    return _cache[id(key)][i]


def test_pipeline_odd_rows(spark, odd_docs, no_docs):
    from pyspark.errors import AnalysisException  # noqa: F401

    for start in (odd_docs, no_docs):
        docs = start
        for name, step in corpus_pipeline.STAGES:
            docs = stage(step(spark, docs, SMALL), "t")
            if name != "encoding":
                assert docs.columns == start.columns
    rows = corpus_pipeline.near_duplicates(spark, odd_docs, SMALL).where("doc_id = 0").count()
    assert rows == 1
