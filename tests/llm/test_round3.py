"""Work and memory of single steps of the operators on texts."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from sessionloom.llm import op1_quality, op6_suffix, op10_minhash


def _peak(call):
    tracemalloc.start()
    try:
        out = call()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_pairs_of_a_leaf_take_little_more_than_their_result():
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 3, (2048, op10_minhash.COORDINATES)).astype(np.uint32)
    tokens[::2] = tokens[0]
    sizes = rng.integers(90, 111, 2048)
    near, peak = _peak(lambda: op10_minhash._alike(tokens, tokens, sizes, sizes, 85))
    assert peak < 24 << 20
    for i in (0, 1, 63, 64, 1000, 2047):
        equal = (tokens == tokens[i]).sum(axis=1) >= op10_minhash._likely(85)
        assert (near[i] == equal & (100 * np.minimum(sizes, sizes[i]) >= 85 * np.maximum(sizes, sizes[i]))).all()


def test_trigram_counts_of_a_task_take_four_bytes_each():
    batch = pa.RecordBatch.from_pydict({"text": ["abcabc" * 1000, None, "", "xy", "abcd"]})
    rows, peak = _peak(lambda: [r for b in op1_quality._count([batch]) for r in b.to_pylist()])
    assert peak < 100 << 20
    assert {(r["gram"], r["n"]) for r in rows} == {
        (int.from_bytes(g, "big"), n) for g, n in ((b"abc", 2001), (b"bca", 1999), (b"cab", 1999), (b"bcd", 1))}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_shared_anchors_over_batches(size):
    rng = np.random.default_rng(size)
    anchor = np.sort(rng.integers(0, 120, 300))
    ids = np.where(anchor % 3 == 0, anchor, rng.integers(0, 3, 300))
    rows = pa.RecordBatch.from_pydict({"anchor": anchor, "doc_id": ids, "at": np.arange(300)})
    got = sorted(x for b in op6_suffix._shared(rows.slice(lo, size) for lo in range(0, 300, size)) for x in b.column("at").to_pylist())
    docs = {a: set(ids[anchor == a].tolist()) for a in anchor.tolist()}
    assert got == [i for i, a in enumerate(anchor.tolist()) if len(docs[a]) > 1]


def _context(left, right):
    return bytes([len(left)]) + left + b"A" * 10 + b"B" * 10 + right


def test_contexts_that_share_no_window_are_not_ordered(monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    left, right = word(30), word(30)
    contexts = [_context(word(30), word(30)) for _ in range(50)]  # nothing but the anchor
    contexts += [_context(word(18) + left[-12:], right[:17] + b"-" + word(12))] * 1 + [_context(word(18) + left[-12:], right[:17] + b"+" + word(12))]  # 49 bytes
    contexts += [_context(word(18) + left[-12:], right[:18] + b"-" + word(11)), _context(word(18) + left[-12:], right[:18] + b"+" + word(11))]  # 50 bytes
    n = len(contexts)
    rows = pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, 9)), pa.array(np.arange(n)), pa.array(np.arange(n) + 100), pa.array(np.full(n, 31, np.int32)), pa.array(contexts, pa.binary())],
        ["anchor", "mark", "first_doc", "windows", "context"])
    seen = []
    whole = op6_suffix.suffix_order
    monkeypatch.setattr(op6_suffix, "suffix_order", lambda text, *a: seen.append(len(text)) or whole(text, *a))
    got = {r["mark"]: r for b in op6_suffix._ordered([rows]) for r in b.to_pylist()}
    assert sum(seen) <= 4 * 81  # not the fifty others
    assert got[n - 1]["least"] is None
    assert got[n - 1]["limits"] == [100 + n - 1] * 18 + [100 + n - 2] + [100 + n - 1] * 12
    assert got[n - 2]["least"] == 100 + n - 2
