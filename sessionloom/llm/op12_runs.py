"""Periodic runs of words: maximal stretches that repeat with a period, found by internal pattern matching.

The texts of a block are one sequence of word numbers, each text closed by a number of its own. Its suffix array comes from
prefix doubling; round k also gives, for every block of 2^k words at a multiple of 2^k, the suffix array range of all its
occurrences. A wavelet tree over the suffix array then answers, for each such block, which occurrence follows and which
precedes it. Occurrences of a block within a window of its own length form a progression, so the gap d to the neighbour is
its difference, and the stretch between both occurrences has period d.

Why nothing is lost: let a run have smallest period q and at least 4q words, and L be the power of two with L/2 < q <= L.
Some block of L words lies in the run within its first 2q - 1 words, and a block of at least q words recurs inside the run at
multiples of q only. So either the next occurrence is q further, or, when the block starts q or more words into the run, the
previous one is q before. Gaps outside (L/2, L] belong to other rounds. Stretches of one period that share d words are joined,
then grown word by word to their ends; a stretch whose period isn't its smallest would have shown the smaller gap.

Defined cases: null and empty texts have no words, no runs, and empty digests' input. Rows without an id are not edited by the
query. Repeated rows give equal answers. A run has at least max(6, 4 * period) words. Every text is read whole; texts longer
than a block are a block of their own, so memory follows the longest text. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_package
from .common import table

#: Words handled together: whole texts up to this many, or one longer text.
WORDS = 1 << 18
LEAST, EXPONENT = 6, 4


# suffix array and wavelet tree

def suffixes(seq: np.ndarray, tallest: int):
    """Suffix array of ``seq``, and ``(starts, lengths, low, high)`` of repeated dyadic blocks of up to ``tallest`` words.

    ``low`` to ``high`` is the suffix array range of a block's occurrences. Suffixes that stand alone leave the sorting.
    """
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    new = np.ones(n, bool)
    new[1:] = seq[order][1:] != seq[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    blocks, width = [], 1
    while True:
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, n))
        if width <= tallest:
            at = np.arange(0, n - width + 1, width)
            low = rank[at]
            high = low + size[np.searchsorted(heads, low)]
            again = high - low > 1
            blocks.append((at[again], np.full(int(again.sum()), width), low[again], high[again]))
        open_heads = size > 1
        if not open_heads.any() or 2 * width > tallest:  # a range holds the same places in whatever order they follow
            break
        live = np.repeat(heads[open_heads], size[open_heads])  # places in ``order`` that still share a rank
        live += np.arange(len(live)) - np.repeat(np.cumsum(size[open_heads]) - size[open_heads], size[open_heads])
        own = order[live]
        follow = np.where(own + width < n, rank[np.minimum(own + width, n - 1)], -1)
        by = np.lexsort((follow, rank[own]))
        own, follow = own[by], follow[by]
        order[live] = own
        here = rank[own]
        cut = np.ones(len(live), bool)
        cut[1:] = (here[1:] != here[:-1]) | (follow[1:] != follow[:-1])
        new[live] = cut
        head = np.maximum.accumulate(np.where(cut, live, 0))
        rank[own] = head
        width *= 2
    return order, tuple(np.concatenate(c) for c in zip(*blocks))


class WaveletTree:
    """Bit planes of a sequence, highest first, each sorted stably by the planes above it; ranks by 64-bit words."""

    def __init__(self, values: np.ndarray):
        self.levels = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.bits, self.ones, self.zeros = [], [], []
        n = len(values)
        cur = values
        for level in reversed(range(self.levels)):
            bit = (cur >> level) & 1 == 1
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(n // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.bits.append(words)
            self.ones.append(before)
            self.zeros.append(n - int(bit.sum()))
            cur = np.concatenate([cur[~bit], cur[bit]])

    def _rank(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of plane ``k`` before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[k][word] + np.bitwise_count(self.bits[k][word] & mask)

    def below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of the values at ``low`` to ``high`` are smaller than ``value``."""
        out = np.zeros(len(low), np.int64)
        for k in range(self.levels):
            a, b = self._rank(k, low), self._rank(k, high)
            one = (value >> (self.levels - 1 - k)) & 1 == 1
            out += np.where(one, (high - low) - (b - a), 0)
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return out

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ``n``-th smallest value at ``low`` to ``high``."""
        out = np.zeros(len(low), np.int64)
        for k in range(self.levels):
            a, b = self._rank(k, low), self._rank(k, high)
            zeros = (high - low) - (b - a)
            one = n >= zeros
            n = np.where(one, n - zeros, n)
            out = (out << 1) | one
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return out


# runs

def _candidates(seq: np.ndarray, longest: int):
    """``(period, start, end)``: stretches between neighbouring occurrences of dyadic blocks."""
    tallest = 1
    while tallest * EXPONENT < 2 * longest:  # no period above longest / 4
        tallest *= 2
    order, (at, width, low, high) = suffixes(seq, tallest)
    found = []
    near = width <= 2  # windows of one or two words are read in place
    for w in (1, 2):
        s = at[near & (width == w)]
        if w == 2:
            s = s[seq[s] != seq[s + 1]]  # two equal words: a nearer neighbour, if any
        for d in range(w // 2 + 1, w + 1):
            for other in (s + d, s - d):
                ok = (other >= 0) & (other + w <= len(seq))
                a, b = s[ok], other[ok]
                same = seq[a] == seq[b]
                if w == 2:
                    same &= seq[a + 1] == seq[b + 1]
                a, b = a[same], b[same]
                found.append((np.full(len(a), d), np.minimum(a, b), np.maximum(a, b) + w))
    at, width, low, high = at[~near], width[~near], low[~near], high[~near]
    if len(at):
        tree = WaveletTree(order)
        own = tree.below(low, high, at)  # the block's own place among its occurrences
        for step in (1, -1):
            ok = (own + step >= 0) & (own + step < high - low)
            s, w = at[ok], width[ok]
            d = np.abs(tree.nth(low[ok], high[ok], own[ok] + step) - s)
            fits = (d <= w) & (2 * d > w)
            s, w, d = s[fits], w[fits], d[fits]
            found.append((d, s, s + w + d) if step == 1 else (d, s - d, s + w))
    return tuple(np.concatenate(c) for c in zip(*found))


def _joined(period: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Stretches of one period that share at least that many words become one."""
    by = np.lexsort((start, period))
    period, start, end = period[by], start[by], end[by]
    if not len(period):
        return period, start, end
    fresh = np.ones(len(period), bool)
    fresh[1:] = period[1:] != period[:-1]
    # the furthest end so far within the period: ends are made to grow from one period to the next
    lift = (np.cumsum(fresh) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    cut = fresh.copy()
    cut[1:] |= start[1:] > reach[:-1] - period[1:]
    first = np.flatnonzero(cut)
    return period[first], start[first], np.maximum.reduceat(end, first)


def _grown(seq: np.ndarray, period: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Stretches with ``period`` as far as it holds to either side."""
    start, end = start.copy(), end.copy()
    n = len(seq)
    live = np.arange(len(start))
    while len(live):
        e = end[live]
        live = live[(e < n) & (seq[np.minimum(e, n - 1)] == seq[e - period[live]])]
        end[live] += 1
    live = np.arange(len(start))
    while len(live):
        s = start[live]
        live = live[(s > 0) & (seq[s - 1] == seq[s - 1 + period[live]])]
        start[live] -= 1
    return start, end


def find_runs(seq: np.ndarray, longest: int):
    """``(start, length, period)`` arrays of all runs of ``seq``, by start and period.

    ``longest``: words of the longest text in it; texts end with numbers that stand nowhere else.
    """
    if len(seq) < LEAST:
        return (np.zeros(0, np.int64),) * 3
    period, start, end = _joined(*_candidates(seq, longest))
    start, end = _grown(seq, period, start, end)
    keep = end - start >= np.maximum(LEAST, EXPONENT * period)
    found = np.unique(np.column_stack([start[keep], period[keep], end[keep] - start[keep]]), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def _text_row(words: list[bytes], start: list[int], length: list[int], period: list[int], collapsed: bool) -> tuple:
    """Counts, the strongest run, the two digests, and with ``collapsed`` the text without its repeats."""
    digest = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in zip(start, length, period)).encode()).hexdigest()
    best: tuple = (None, None, None, None)
    if start:
        drop = np.zeros(len(words) + 1, np.int32)
        s, m, q = 0, 0, 1
        for a, b, c in zip(start, length, period):
            drop[a + c] += 1
            drop[a + b] -= 1
            if b * q > m * c or not m:  # exact comparison; ties stay with the smaller start, then period
                s, m, q = a, b, c
        best = (s, m, q, 1000 * m // q)
        gone = np.cumsum(drop[:-1]) > 0
        words = [w for w, g in zip(words, gone.tolist()) if not g]
    left = b" ".join(words)
    return len(start), *best, digest, hashlib.sha256(left).hexdigest(), left.decode() if collapsed else None


RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, edit=None, collapsed: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, number of runs, the strongest one, and digests; with ``collapsed`` also the text
    without the repeats. ``edit(doc_id, words)`` may replace a text's words first."""
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            out: list[tuple] = []
            held: list[list[bytes]] = []
            count = 0
            for doc_id, text in zip(ids.to_pylist(), batch.column("text")):
                words = (text.as_py() or "").encode().split()  # bytes split at 0x20 and 0x09 to 0x0D only
                if edit is not None and words:
                    words = edit(doc_id, words)
                if held and count + len(words) > WORDS:
                    out += _block(held, collapsed)
                    held, count = [], 0
                held.append(words)
                count += len(words)
            out += _block(held, collapsed)
            cols = list(zip(*out)) if out else [[] for _ in range(8)]
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds)]
            if collapsed:
                arrays.append(pa.array(cols[7], pa.string()))
            yield pa.RecordBatch.from_arrays([ids, *arrays], names)

    fields = f"doc_id {kind}, {RESULT}" + (", collapsed string" if collapsed else "")
    names = [f.split()[0] for f in fields.split(", ")]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, fields)


def _block(texts: list[list[bytes]], collapsed: bool) -> list[tuple]:
    """Result rows of some texts, found together."""
    sizes = np.asarray([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    seq = np.empty(int(begin[-1]), np.int64)
    for i, words in enumerate(texts):
        seq[begin[i]:begin[i + 1] - 1] = list(map(numbers.__getitem__, words))
    seq[begin[1:] - 1] = len(numbers) + np.arange(len(texts))
    start, length, period = find_runs(seq, int(sizes.max(initial=0)))
    owner = np.searchsorted(begin, start, "right") - 1
    edges = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    start = (start - begin[owner]).tolist()
    length, period = length.tolist(), period.tolist()
    return [_text_row(words, start[a:b], length[a:b], period[a:b], collapsed) for words, a, b in zip(texts, edges, edges[1:])]


def repeat_tail(doc_id, words: list[bytes]) -> list[bytes]:
    """The query's edit: every tenth text, by a hash of its id, repeats a piece of itself to its end."""
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, one in ten of them edited to end in a repeat."""
    return periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), repeat_tail)


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
SQL: dict[str, str] = {}
