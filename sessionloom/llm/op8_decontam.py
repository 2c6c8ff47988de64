"""Benchmark decontamination by spaced seeds: word overlaps that tolerate substitutions.

Fixed masks over ``SPAN`` words each ignore some positions, so a passage with changed words still agrees with the test item
under a mask that skips the change. The hashes of all masks at all positions of the test items are joined with those of
the documents. A fixed bit map of the test hashes (``FILTER_BITS`` bits, whatever the number of items) lets document
tasks drop positions that can't join before the shuffle; what it lets through by chance, the join removes.

For each way to lay an item along a document that has hits, the words of both are compared as far as the item reaches. The
item is found if some stretch that holds any of these hits has at least ``LEAST`` equal words and at least ``SHARE`` of its
words equal, or if a shorter item is there as a whole (then at least ``SHARE`` of it).

An item of fewer than ``SPAN`` words is found where its whole word sequence stands unchanged; its hash is its only seed.
Shorter ones than ``SHORTEST`` words are common phrases, no leaks, and are not looked for. Every character of a script that
is written without spaces is a word; punctuation and symbols outside ASCII separate words as those of ASCII do.

Defined cases: null or empty texts are clean; repeated rows and items get equal answers, one for each item id; null ids stay
null. Empty tables give clean documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import list_array, mix, stage, table, text_blocks, word_hashes

SPAN = 10
#: Positions that each mask looks at; every mask skips four of the ten.
MASKS = ("1101100101", "1011010011", "1110001101", "1010101110")
#: Hits of a document closer than this share a region; it bounds no comparison, the longest item's words do.
REACH = 64
LEAST, SHARE = 13, 0.8
#: Least words of an item.
SHORTEST = 5
# The ranges come first: they rule out most characters before scripts and categories are looked up. No script here begins below U+0E00.
UNSPACED = r"([[^\x00-\x{DFF}]&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsBopomofo}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]])"
BETWEEN = r"[[^\x00-\x7F]&&[\p{P}\p{S}\p{Z}]]"
FILTER_BITS = 1 << 24

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SAME = np.arange(256, dtype=np.uint8)  # texts come in lower case
_FACTORS = mix(np.arange(1, SPAN + 1, dtype=np.uint64)) | np.uint64(1)


def _seeds(words: np.ndarray, mask: int) -> np.ndarray:
    """Hash of the masked words at each position; windows that reach over a text's end are the caller's to leave out."""
    n = len(words) - SPAN + 1
    total = np.full(max(n, 0), mask + 1, np.uint64)
    for i, on in enumerate(MASKS[mask]):
        if on == "1" and n > 0:
            total += words[i:i + n] * _FACTORS[i]
    return mix(total)


def _whole(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words at each position."""
    n = len(words) - k + 1
    total = np.full(max(n, 0), 1000 + k, np.uint64)
    for i in range(k):
        if n > 0:
            total += words[i:i + n] * _FACTORS[i]
    return mix(total)


def _starts(edge: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Positions whose window lies in one text."""
    n = np.diff(edge)
    total = int(edge[-1])
    ok = np.zeros(max(total - span + 1, 0), bool)
    for a, k in zip(edge[:-1][n >= span].tolist(), n[n >= span].tolist()):
        ok[a:a + k - span + 1] = True
    return ok


def _bits(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _item_seeds(batches):
    for batch, data, off in text_blocks(batches):
        words, edge, _, _ = word_hashes(data, off, ~_WORD, _SAME)
        ok = np.flatnonzero(_starts(edge))
        row = np.searchsorted(edge, ok, "right") - 1
        ids = batch.column("item_id").take(pa.array(row))
        for m in range(len(MASKS)):
            h = _seeds(words, m)[ok]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(ok - edge[row], pa.int32()), pa.array(h.view(np.int64))], ["item_id", "item_at", "seed"])
        n = np.diff(edge)
        for k in range(SHORTEST, SPAN):
            row = np.flatnonzero(n == k)
            if len(row):
                h = _whole(words, k)[edge[row]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id").take(pa.array(row)), pa.array(np.zeros(len(row)), pa.int32()), pa.array(h.view(np.int64))],
                    ["item_id", "item_at", "seed"])


def _words(batches, key: str):
    for batch, data, off in text_blocks(batches):
        words, edge, _, _ = word_hashes(data, off, ~_WORD, _SAME)
        yield pa.RecordBatch.from_arrays([batch.column(key), list_array(words.view(np.int64), edge, pa.int64())], [key, "words"])


def _regions(batches, allowed: np.ndarray, longest: int, short: list[int]):
    """Stretches of a document around possible hits: their words, and seeds with their place in the stretch.

    A stretch reaches ``longest`` words to either side of its hits, so no item is cut off; stretches are wide enough for
    these margins not to repeat a word more than a few times.
    """
    gap, width = max(REACH, 2 * longest), max(16 * REACH, 2 * longest)
    allowed = np.unpackbits(allowed, bitorder="little").view(bool)
    for batch, data, off in text_blocks(batches):
        words, edge, _, _ = word_hashes(data, off, ~_WORD, _SAME)
        ok = _starts(edge)
        at, seeds = [], []
        for k in short:
            h = _whole(words, k)
            hit = np.flatnonzero(_starts(edge, k) & allowed[_bits(h)])
            at.append(hit)
            seeds.append(h[hit])
        for m in range(len(MASKS)):
            h = _seeds(words, m)
            hit = np.flatnonzero(ok & allowed[_bits(h)])
            at.append(hit)
            seeds.append(h[hit])
        at, seeds = np.concatenate(at), np.concatenate(seeds)
        if not len(at):
            continue
        order = np.argsort(at, kind="stable")
        at, seeds = at[order], seeds[order]
        row = np.searchsorted(edge, at, "right") - 1
        cut = np.flatnonzero((np.diff(at) > gap) | (np.diff(row) > 0) | (np.diff(at // width) > 0)) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
        first = np.maximum(edge[row[begin]], at[begin] - longest)
        last = np.minimum(edge[row[begin] + 1], at[end - 1] + longest)
        size = last - first
        ends = np.cumsum(size)
        flat = words[np.repeat(first - ends + size, size) + np.arange(ends[-1])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(row[begin])), pa.array(first - edge[row[begin]], pa.int64()),
             list_array(flat.view(np.int64), np.concatenate([[0], ends]), pa.int64()),
             list_array(seeds.view(np.int64), np.concatenate([begin, [len(at)]]), pa.int64()),
             list_array(at - np.repeat(first, end - begin), np.concatenate([begin, [len(at)]]), pa.int32())],
            ["doc_id", "start", "words", "seeds", "places"])


def _best(equal: np.ndarray, hits: np.ndarray) -> tuple[int, int]:
    """Equal words and start of the stretch with most of them that holds one of the sorted ``hits`` and is equal to ``SHARE``."""
    total = np.concatenate([[0], np.cumsum(equal)])
    height = 100 * total - round(100 * SHARE) * np.arange(len(total))  # a stretch is equal to SHARE if it doesn't descend
    last = np.searchsorted(hits + SPAN, np.arange(len(total)), "right") - 1  # of the hits that end before a word
    left = np.searchsorted(-np.minimum.accumulate(height), -height)  # the longest stretch that ends there
    good = (last >= 0) & (left <= hits[np.maximum(last, 0)])
    same = np.where(good, total - total[left], 0)
    at = int(np.argmax(same))
    begin = int(left[at])
    return int(same[at]), begin + int(np.argmax(equal[begin:])) if same[at] else 0


def _verify(batches):
    for batch in batches:
        n = batch.num_rows
        shift = batch.column("shift").to_numpy()
        best, first, count = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        mine, theirs, places = batch.column("words"), batch.column("item_words"), batch.column("places")
        for i in range(n):
            a, b = mine[i].values.to_numpy(), theirs[i].values.to_numpy()
            lo, hi = max(0, shift[i]), min(len(a), shift[i] + len(b))
            equal = a[lo:hi] == b[lo - shift[i]:hi - shift[i]]
            if len(b) < SPAN:
                best[i], begin = (len(b) if len(equal) == len(b) and equal.all() else 0), 0
            else:
                best[i], begin = _best(equal, np.unique(places[i].values.to_numpy()) - lo)
            first[i], count[i] = lo + begin, len(b)
        good = best >= np.minimum(LEAST, np.ceil(SHARE * count))
        keep = pa.array(good)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").filter(keep), batch.column("item_id").filter(keep), pa.array(best[good]),
             pa.array((batch.column("start").to_numpy() + first)[good])], ["doc_id", "item_id", "n_equal", "at"])


def _spaced(text: str):
    """The column in lower case, with spaces around the characters of unspaced scripts and for punctuation outside ASCII."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), BETWEEN, " "), UNSPACED, " $1 ")


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, n_equal, at)``: the best overlap of each document and item, ``at`` in words of the document."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), _spaced("text").alias("text"))
    seeds = stage(items.mapInArrow(_item_seeds, "item_id long, item_at int, seed long"), "item_seeds")
    words = stage(items.mapInArrow(lambda it: _words(it, "item_id"), "item_id long, words array<long>"), "item_words")
    # the filter has a fixed size: FILTER_BITS / 8 bytes, built from at most FILTER_BITS distinct places
    places = seeds.select(F.expr(f"seed & {FILTER_BITS - 1}").alias("p")).distinct()
    bits = places.groupBy(F.expr("p div 8").cast("int").alias("byte")).agg(F.sum(F.expr("shiftleft(1, cast(p % 8 as int))")).alias("b"))
    allowed = np.zeros(FILTER_BITS // 8, np.uint8)
    for byte, value in bits.toLocalIterator():
        allowed[byte] = value
    shared = spark.sparkContext.broadcast(allowed)
    longest = words.agg(F.max(F.size("words"))).first()[0] or 0
    short = [r.n for r in words.select(F.size("words").alias("n")).where(f"n >= {SHORTEST} and n < {SPAN}").distinct().collect()]  # at most SPAN
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _spaced("text").alias("text"))
    regions = stage(docs.mapInArrow(
        lambda it: _regions(it, shared.value, longest, short),
        "doc_id long, start long, words array<long>, seeds array<long>, places array<int>").withColumn("region", F.monotonically_increasing_id()),
        "regions")
    hits = regions.select("region", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(
        "region", F.col("s.seeds").alias("seed"), F.col("s.places").alias("place")).join(seeds, "seed")
    # one check for each way to lay an item along a stretch, with all its hits
    ways = hits.groupBy("region", "item_id", (F.col("place") - F.col("item_at")).alias("shift")).agg(
        F.collect_set("place").alias("places"))
    both = (ways.join(regions.select("region", "doc_id", "start", "words"), "region")
            .join(words.select("item_id", F.col("words").alias("item_words")).dropDuplicates(["item_id"]), "item_id"))
    found = both.select("doc_id", "item_id", "start", "words", "item_words", "shift", "places").mapInArrow(
        _verify, "doc_id long, item_id long, n_equal long, at long")
    best = F.max(F.struct("n_equal", (-F.col("at")).alias("at")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", F.col("b.n_equal").alias("n_equal"), (-F.col("b.at")).alias("at"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of benchmark items that it holds, and the one it overlaps most."""
    docs = table(spark, sf_dir, "documents")
    found = overlaps(docs, table(spark, sf_dir, "benchmark"))
    worst = found.groupBy("doc_id").agg(
        F.count("*").alias("n_items"), F.max(F.struct("n_equal", (-F.col("item_id")).alias("item_id"))).alias("w"))
    return docs.select("doc_id").join(worst, "doc_id", "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        (-F.col("w.item_id")).alias("item_id"), F.coalesce("w.n_equal", F.lit(0).cast("long")).alias("n_equal"))


QUERIES = {"op8_decontamination": op8_decontamination}
SQL: dict[str, str] = {}
