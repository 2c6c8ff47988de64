"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of byte trigrams.

Training counts the trigrams of all trusted texts (labelled good) and derives, by joins of the count tables, the smoothed
probability of every seen trigram, the weight that each context leaves to shorter ones, and the bigram level below. There
are at most 2^24 trigrams and 2^16 bigrams, whatever the size of the corpus.

Scoring packs the trigram counts of every document by shard of the trigram's context and joins them with that shard of the
model. Packed rows are spread over salted keys, so no trigram, however frequent, meets one task. Each join gives a part of
a document's log-probability; the parts are summed by document. Perplexity is two to the mean bits of a trigram.

A document is rejected if its bits lie outside the range of trusted texts of its language and length (bands of doubling
size): the ``QUANTILES`` of their bits, widened by ``MARGIN`` times their distance from the median. Bands with fewer than
``ENOUGH`` trusted texts use the whole language's ``WIDE`` quantiles, widened by their whole distance; a language without
enough trusted texts uses those of all texts. Quantiles come from mergeable sketches and cover all trusted rows.

Defined cases: texts of fewer than three bytes (null texts too) have no trigram, no perplexity and are kept; rows without
``doc_id`` are not scored and are kept; rows that repeat an id are scored together; null ``lang`` is a language of its own;
without trusted texts everything is kept. Columns other than ``doc_id``, ``text`` and ``lang`` are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import parts, stage, table, text_blocks

SHARDS = 16
#: Bytes of text whose trigram counts are packed together: fewer and longer loads compress better.
PACKED = 1 << 20
QUANTILES, MARGIN = (0.01, 0.5, 0.99), 0.5
WIDE = (0.001, 0.5, 0.999)
ENOUGH = 50


def _trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, trigram and count, sorted by document and trigram."""
    if len(data) < 3:
        return (np.zeros(0, np.int64),) * 3
    x = data.astype(np.int64)
    gram = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = row[:-2] == row[2:]
    key = np.sort((row[:-2] << 24 | gram)[inside])
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] >> 24, key[first] & 0xFFFFFF, np.diff(first, append=len(key))


def _count(batches):
    total, size = None, 0

    def done():
        gram = np.flatnonzero(total)
        for lo in range(0, len(gram), 100_000):
            g = gram[lo:lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(total[g].astype(np.int64))], ["gram", "n"])
        total[:] = 0

    for _, data, off in text_blocks(batches):
        _, gram, n = _trigrams(data, off)
        if total is None:
            total = np.zeros(1 << 24, np.uint32)
        if size + len(data) > 0xFFFFFFFF:  # so no count overflows
            yield from done()
            size = 0
        size += len(data)
        np.add.at(total, gram, n.astype(np.uint32))
    if total is not None:
        yield from done()


def _shard(gram):
    return ((gram >> 8) * 0x9E37 >> 7) % SHARDS


def _vectors(batches, salts: int):
    """Packed trigram counts: a row for each block of texts and shard."""
    pack = zstandard.ZstdCompressor(level=1).compress
    number = 0
    for batch, data, off in text_blocks(batches, limit=PACKED):
        row, gram, n = _trigrams(data, off)
        shard = _shard(gram)
        ids = batch.column("doc_id").to_numpy()
        out = []
        for s in range(SHARDS):
            mine = shard == s
            docs, sizes = np.unique(row[mine], return_counts=True)
            if len(docs):
                number += 1
                load = np.concatenate([sizes, gram[mine], n[mine]]).astype("<i4").tobytes()
                out.append((s, (number + int(ids[docs[0]])) % salts, ids[docs], pack(load)))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()),
                 pa.array([o[2] for o in out], pa.list_(pa.int64())), pa.array([o[3] for o in out], pa.binary())],
                ["shard", "salt", "docs", "load"])


def _bits(batches, below: np.ndarray):
    """Bits of each packed document's trigrams in one shard."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for i in range(batch.num_rows):
            docs = batch.column("docs")[i].values.to_numpy()
            load = np.frombuffer(unpack(batch.column("load")[i].as_py()), "<i4").astype(np.int64)
            sizes, rest = load[:len(docs)], load[len(docs):]
            gram, n = np.split(rest, 2)
            known, p, contexts, left = (batch.column(c)[i].values.to_numpy() for c in ("grams", "p", "contexts", "left"))
            value = below[gram & 0xFFFF]
            if len(contexts):
                at = np.minimum(np.searchsorted(contexts, gram >> 8), len(contexts) - 1)
                value = np.where(contexts[at] == gram >> 8, left[at], 1.0) * value
                at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                value = np.where(known[at] == gram, p[at], value)
            edge = np.cumsum(sizes) - sizes
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs), pa.array(np.add.reduceat(-np.log2(value) * n, edge)), pa.array(np.add.reduceat(n, edge))], ["doc_id", "bits", "n"])


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts of counts one, two and more, from how many counts are one to four."""
    r = counts.agg(*[F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n = [r[f"n{k}"] or 0 for k in (1, 2, 3, 4)]
    if 0 in n:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]


def _discount(n: Column, d: list[float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def _contexts(counts: DataFrame, d: list[float]) -> DataFrame:
    """``(context, total, left)``: all counts after a context, and the part that discounting takes from them."""
    return counts.groupBy(F.shiftright("gram", 8).alias("context")).agg(
        F.sum("n").alias("total"), (F.sum(_discount(F.col("n"), d)) / F.sum("n")).alias("left"))


def train(trusted: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The trigram level, one row for each shard, and the probabilities of all 65,536 bigrams."""
    grams = stage(trusted.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "gram long, n long").groupBy("gram").agg(
        F.sum("n").alias("n")), "trigrams")
    pairs = stage(grams.groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("gram")).agg(F.count("*").alias("n")), "bigrams")
    ones = pairs.groupBy(F.col("gram").bitwiseAND(0xFF).alias("gram")).agg(F.count("*").alias("n"))
    d3, d2, d1 = _discounts(grams), _discounts(pairs), _discounts(ones)
    one = np.zeros(256)
    rows = ones.collect()  # at most 256
    total = sum(r.n for r in rows)
    for r in rows:
        one[r.gram] = (r.n - d1[min(r.n, 3) - 1]) / total
    one += (1 - one.sum()) / 256
    below = np.tile(one, (256, 1))
    for r in _contexts(pairs, d2).collect():  # at most 256
        below[r.context] *= r.left
    seen = pairs.join(_contexts(pairs, d2), F.shiftright("gram", 8) == F.col("context")).select(
        "gram", ((F.col("n") - _discount(F.col("n"), d2)) / F.col("total")).alias("p"))
    for r in seen.collect():  # at most 65,536
        below.reshape(-1)[r.gram] += r.p
    below = below.reshape(-1)
    pair = grams.sparkSession.createDataFrame([(i, float(p)) for i, p in enumerate(below)], "pair long, q double")
    contexts = _contexts(grams, d3)
    level = grams.join(contexts, F.shiftright("gram", 8) == F.col("context")).join(pair, F.col("gram").bitwiseAND(0xFFFF) == F.col("pair"))
    level = level.select("gram", "context", "left", ((F.col("n") - _discount(F.col("n"), d3)) / F.col("total") + F.col("left") * F.col("q")).alias("p"))
    shard = F.expr(f"(context * {0x9E37} div 128) % {SHARDS}").cast("int").alias("shard")
    return level.groupBy(shard).agg(
        F.sort_array(F.collect_list(F.struct("gram", "p"))).alias("g"), F.sort_array(F.collect_set(F.struct("context", "left"))).alias("c")).select(
        "shard", F.col("g.gram").alias("grams"), F.col("g.p").alias("p"), F.col("c.context").alias("contexts"), F.col("c.left").alias("left")), below


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``(doc_id, n, bits)``: trigrams of each document that has any, and their mean bits under the model of ``trusted``."""
    spark = docs.sparkSession
    level, below = train(trusted)
    salts = max(1, parts(spark) // SHARDS)
    every = spark.range(SHARDS).select(F.col("id").cast("int").alias("shard"))
    none = F.array().cast("array<double>")
    model = every.join(level, "shard", "left").select(
        "shard", F.coalesce("grams", F.array().cast("array<bigint>")).alias("grams"), F.coalesce("p", none).alias("p"),
        F.coalesce("contexts", F.array().cast("array<bigint>")).alias("contexts"), F.coalesce("left", none).alias("left"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = rows.mapInArrow(lambda it: _vectors(it, salts), "shard int, salt int, docs array<long>, load binary")
    some = packed.join(model, ["shard", "salt"]).select("docs", "load", "grams", "p", "contexts", "left")
    bits = some.mapInArrow(lambda it: _bits(it, below), "doc_id long, bits double, n long")
    return bits.groupBy("doc_id").agg(F.sum("n").alias("n"), F.round(F.sum("bits") / F.sum("n"), 6).alias("bits"))


def _range(rows: DataFrame, keys: list[str], q: tuple, margin: float, name: str) -> DataFrame:
    """Limits of the bits of trusted rows, one row for each value of ``keys`` with enough of them."""
    p = F.percentile_approx("bits", list(q), 10_000).alias("q")
    found = rows.groupBy(*keys).agg(F.count("*").alias("k"), p).where(F.col("k") >= ENOUGH)
    low, mid, high = (F.col("q")[i] for i in range(3))
    return found.select(*keys, F.struct((low - margin * (mid - low)).alias("low"), (high + margin * (high - mid)).alias("high")).alias(name))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, lang, n_trigrams, perplexity, low, high, kept)`` for each row of ``docs``; trusted are ``labels.quality = 1``."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    # one way to join at every size: the texts meet the labels in a shuffle, never by a broadcast of all labels
    bits = stage(perplexities(own, own.join(good.hint("merge"), "doc_id", "left_semi")), "bits")
    scored = stage(own.select("doc_id", "lang").join(bits, "doc_id", "left").withColumn(
        "band", F.floor(F.log2(F.greatest("n", F.lit(1)))).cast("int")), "scored")
    trusted = scored.join(good, "doc_id", "left_semi").where("bits is not null")
    narrow = _range(trusted, ["lang", "band"], QUANTILES, MARGIN, "_narrow")
    wide = _range(trusted, ["lang"], WIDE, 1.0, "_wide")
    every = _range(trusted.withColumn("_all", F.lit(1)), ["_all"], WIDE, 1.0, "_every").select("_every").collect()
    rest = F.struct(F.lit(every[0]._every.low).alias("low"), F.lit(every[0]._every.high).alias("high")) if every else F.lit(None).cast("struct<low: double, high: double>")
    limits = F.coalesce("_narrow", "_wide", rest)
    # few languages hold most rows: the small tables of limits are repeated for salted keys
    salts = parts(docs.sparkSession)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_salt")
    rows = scored.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("long"))
    done = (rows.join(narrow.select("*", copies), ["lang", "band", "_salt"], "left").join(wide.select("*", copies), ["lang", "_salt"], "left")
            .withColumn("_limits", limits))
    kept = F.coalesce((F.col("bits") >= F.col("_limits.low")) & (F.col("bits") <= F.col("_limits.high")), F.lit(True))
    return done.select(
        "doc_id", F.when(F.col("lang") != "", F.col("lang")).alias("lang"), F.coalesce("n", F.lit(0).cast("long")).alias("n_trigrams"),
        F.pow(F.lit(2.0), "bits").alias("perplexity"), F.pow(F.lit(2.0), "_limits.low").alias("low"), F.pow(F.lit(2.0), "_limits.high").alias("high"),
        kept.alias("kept"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document, and whether it is kept."""
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_quality": op1_quality}
SQL: dict[str, str] = {}
