"""Exact duplicates of arriving texts against immutable snapshots, screened by static binary-fuse filters.

A batch's equal texts are grouped first: tasks merge the copies they meet (byte for byte, ``HELD`` bytes of text at a time), so a
hot text enters the shuffle a few times a task, and the rest meets by digest. The batch's distinct texts are written once, bucketed
by digest: these are the exact buckets of the snapshot that the batch becomes. Each snapshot has one binary-fuse filter for each
shard of its digests, built when it is written and never changed: about nine bits a text and one false hit in 256.

Digests of a batch meet the filters by shard; only hits go to the exact buckets, where texts are compared byte for byte, so neither
a false hit nor equal digests of different texts can join two groups. Texts are shuffled once, when their batch is written.
Rows find their group by digest and a second hash of the text, in a shuffle of narrow rows. Groups with more than one row in
``HOT`` are at most that many; they are broadcast, so no key of the shuffle holds more.

Defined cases: null counts as empty, and texts are equal when identical after each run of white space became one space. The
smallest id of a group stays. Rows without an id belong to their group, count in its size and go if any row of the group has
an id; a group without any id has a null ``keep_id`` and all its rows stay, since none can be told from the others. Rows that repeat
an id and its text both carry that id and stay or go together; the same id with another text is another row. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import new_path, ship_package
from .common import mix, parts, stage, staging, table

#: Bytes of text a task holds while it merges copies.
HELD = 16 << 20
#: Digests of a filter.
SHARD = 1 << 17
#: Groups above one row in so many are hot: there are at most so many.
HOT = 1000


def normalised(text: str) -> Column:
    """White space runs as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _rows(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """``(doc_id, text, digest, second)`` with the normalised text."""
    text = docs.select("doc_id", normalised("text").alias("text"))
    return text.select("doc_id", "text", digest(F.col("text")).alias("digest"), F.xxhash64("text").alias("second"))


# binary-fuse filters

def _places(keys: np.ndarray, seed: int, segments: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Three places in neighbouring segments for each key, and its fingerprint byte."""
    h = mix(keys.astype(np.uint64) ^ np.uint64(seed))
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    mask = np.uint64(length - 1)
    place = [first * np.uint64(length) + (h & mask)]
    place += [(first + np.uint64(i)) * np.uint64(length) + (mix(h + np.uint64(i)) & mask) for i in (1, 2)]
    return np.stack(place).astype(np.int64), (mix(h ^ np.uint64(0xA5)) & np.uint64(255)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """``(seed, segments, segment length, fingerprints)`` of a static set of distinct 64-bit keys.

    Keys that are alone in a place are peeled off, round by round, over the whole array; the fingerprints are then set from the
    last key to the first. A seed that leaves keys unpeeled is followed by the next; the array grows a little for each.
    """
    n, seed = len(keys), 0
    length = 1 << max(2, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    while True:
        room = (0.875 + 0.25 * max(1.0, math.log(1_000_000) / math.log(max(n, 2)))) * (1 + 0.05 * seed)
        segments = max(1, math.ceil(n * room / length) - 2)
        size = (segments + 2) * length
        place, print_ = _places(keys, seed, segments, length)
        count = np.bincount(place.ravel(), minlength=size)
        which = np.zeros(size, np.int64)  # the exclusive or of the keys' numbers: the number itself where there is one
        for p in place:
            np.bitwise_xor.at(which, p, np.arange(n))
        peeled: list[tuple[np.ndarray, np.ndarray]] = []
        single = np.flatnonzero(count == 1)
        left = n
        while len(single):
            key, at = np.unique(which[single], return_index=True)
            peeled.append((key, single[at]))
            left -= len(key)
            touched = place[:, key]
            for p in touched:
                np.subtract.at(count, p, 1)
                np.bitwise_xor.at(which, p, key)
            touched = np.unique(touched)
            single = touched[count[touched] == 1]
        if not left:
            break
        seed += 1
    table_ = np.zeros(size, np.uint8)
    for key, at in reversed(peeled):  # keys of one round never stand in each other's single place
        table_[at] = print_[key] ^ table_[place[0, key]] ^ table_[place[1, key]] ^ table_[place[2, key]]
    return seed, segments, length, table_.tobytes()


def in_filter(keys: np.ndarray, seed: int, segments: int, length: int, prints: np.ndarray) -> np.ndarray:
    place, print_ = _places(keys, seed, segments, length)
    return prints[place[0]] ^ prints[place[1]] ^ prints[place[2]] == print_


# snapshots

@dataclass(frozen=True)
class Snapshot:
    """Distinct texts of one batch: bucketed ``(digest, second, keep_id, n, text)``, filters by shard, numbers of rows and shards."""

    texts: DataFrame
    filters: DataFrame
    count: int
    shards: int


def _merge_copies(batches):
    """Copies within a task as one row; dictionaries compare their keys byte for byte."""
    held: dict[tuple, list] = {}
    size = 0

    def out(items):
        cols = list(zip(*[(*key, *value) for key, value in items]))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
            ["digest", "second", "text", "keep_id", "n"])

    for batch in batches:
        columns = [batch.column(c) for c in ("digest", "second", "text", "doc_id")]
        for i in range(batch.num_rows):
            digest, second, text, doc_id = (c[i].as_py() for c in columns)
            key = (digest, second, text)
            have = held.get(key)
            if have is None:
                held[key] = [doc_id, 1]
                size += len(text)
            else:
                have[1] += 1
                if doc_id is not None and (have[0] is None or doc_id < have[0]):
                    have[0] = doc_id
            if size > HELD:
                yield out(held.items())
                held, size = {}, 0
    if held:
        yield out(held.items())


def _key(digest: str = "digest") -> Column:
    return F.xxhash64(digest)


def snapshot(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> Snapshot:
    """Write the distinct texts of ``docs (doc_id, text)`` as exact buckets with their filters."""
    spark = docs.sparkSession
    ship_package(spark)
    n = parts(spark)
    merged = _rows(docs, digest).select("digest", "second", "text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(
        _merge_copies, "digest string, second long, text string, keep_id long, n long")
    # partitioned as the buckets are: one file a bucket, and later joins on the digest move no text
    grouped = merged.repartition(n, "digest").groupBy("digest", "second", "text").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    name = f"exact_texts_{uuid.uuid4().hex}"
    with staging(spark):
        grouped.write.format("parquet").option("path", new_path(spark, "exact_texts")).bucketBy(n, "digest").saveAsTable(name)
    texts = spark.table(name)
    count = texts.count()
    shards = -(-count // SHARD) or 1

    def build(group: pa.Table) -> pa.Table:
        seed, segments, length, prints = build_filter(np.unique(group.column("key").to_numpy()))
        return pa.table({"shard": group.column("shard").slice(0, 1), "seed": [seed], "segments": [segments], "length": [length],
                         "prints": pa.array([prints], pa.binary())})

    keys = texts.select(_key().alias("key")).select(F.pmod("key", F.lit(shards)).alias("shard"), "key")
    filters = stage(keys.groupBy("shard").applyInArrow(build, FILTER), "fuse_filters")
    return Snapshot(texts, filters, count, shards)


FILTER = "shard long, seed long, segments long, length long, prints binary"


def _probe(batches):
    """Keys that their shard's filter may hold; each part's filter row comes first."""
    own, at = None, None
    for batch in batches:
        part = list(zip(batch.column("shard").to_pylist(), batch.column("part").to_pylist()))
        edges = [i for i in range(len(part)) if not i or part[i] != part[i - 1]] + [len(part)]
        for a, b in zip(edges, edges[1:]):
            if part[a] != at:
                at, own = part[a], None
            if batch.column("prints")[a].is_valid:
                row = {c: batch.column(c)[a].as_py() for c in ("seed", "segments", "length", "prints")}
                own = row["seed"], row["segments"], row["length"], np.frombuffer(row["prints"], np.uint8)
                a += 1
            if own is None or a == b:
                continue
            keys = batch.column("key").slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = pa.array(in_filter(keys, *own))
            yield pa.RecordBatch.from_arrays([batch.column("digest").slice(a, b - a).filter(hit)], ["digest"])


def screen(batch: Snapshot, old: Snapshot) -> DataFrame:
    """``digest`` of the batch's texts that the old snapshot's filters may hold; every digest it holds is among them."""
    copies = -(-batch.count // (4 * SHARD * old.shards)) or 1  # a batch far larger than the snapshot is dealt over copies of each filter
    keys = batch.texts.select("digest").distinct().select("digest", _key().alias("key"))
    keys = keys.select(F.pmod("key", F.lit(old.shards)).alias("shard"), F.pmod(F.xxhash64("key"), F.lit(copies)).alias("part"), "digest", "key")
    filters = old.filters.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
    both = filters.unionByName(keys, allowMissingColumns=True)
    dealt = both.repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("prints").isNull())
    return dealt.mapInArrow(_probe, "digest string")


def matches(batch: Snapshot, old: Snapshot) -> DataFrame:
    """``(digest, second, new_id, new_n, old_id, old_n)``: texts of the batch that stand in the old snapshot, byte for byte."""
    hits = screen(batch, old).hint("merge")
    new = batch.texts.join(hits, "digest", "left_semi").select(
        "digest", F.col("text").alias("_text"), F.col("keep_id").alias("new_id"), F.col("n").alias("new_n"))
    known = old.texts.select("digest", "second", "text", F.col("keep_id").alias("old_id"), F.col("n").alias("old_n"))
    same = F.nullif("text", "_text").isNull()  # an equality would become a join key, and the texts would be shuffled by it
    return new.hint("merge").join(known, "digest").where(same).select("digest", "second", "new_id", "new_n", "old_id", "old_n")


def arrivals(batches: list[DataFrame], digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Batches ``(doc_id, text)`` in order of arrival, each against the snapshots before it.

    One row for each row: ``doc_id, keep_id, group_size, kept, text_digest``, where groups reach over all batches.
    """
    spark = batches[0].sparkSession
    known: list[Snapshot] = []
    found = []
    for i, docs in enumerate(batches):
        own = snapshot(docs, digest)
        for j, old in enumerate(known):
            found.append(stage(matches(own, old), "exact_matches").select(
                F.explode(F.array(
                    F.struct(F.lit(i).alias("batch"), "digest", "second", F.col("old_id").alias("keep_id"), F.col("old_n").alias("n")),
                    F.struct(F.lit(j).alias("batch"), "digest", "second", F.col("new_id").alias("keep_id"), F.col("new_n").alias("n")))).alias("m")).select("m.*"))
        known.append(own)
    groups = [k.texts.select(F.lit(i).alias("batch"), "digest", "second", "keep_id", "n") for i, k in enumerate(known)]
    whole = groups[0]
    for more in groups[1:] + found:
        whole = whole.unionByName(more)
    whole = stage(whole.groupBy("batch", "digest", "second").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n")), "exact_groups")
    rows = None
    for i, docs in enumerate(batches):
        own_rows = _rows(docs, digest).select(F.lit(i).alias("batch"), "doc_id", "digest", "second")
        rows = own_rows if rows is None else rows.unionByName(own_rows)
    return _with_groups(rows, whole)


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row with its group. Hot groups come by broadcast (at most ``HOT`` a batch), the others in a shuffle."""
    total = groups.groupBy("batch").agg(F.sum("n").alias("total"))
    hot = groups.join(F.broadcast(total), "batch").where(F.col("n") * HOT > F.col("total"))  # totals: one row a batch
    hot = hot.select("batch", "digest", "second", F.col("keep_id").alias("_hot_id"), F.col("n").alias("_hot_n"))
    keys = ["batch", "digest", "second"]
    known = rows.join(F.broadcast(hot), keys, "left")
    # rows that have their group are dealt by row and meet nothing
    spread = F.when(F.col("_hot_n").isNotNull(), F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))).otherwise(F.col("digest"))
    rest = groups.select("batch", F.col("digest").alias("_digest"), "second", "keep_id", "n").hint("merge")
    joined = known.withColumn("_digest", spread).join(rest, ["batch", "_digest", "second"], "left")
    keep = F.when(F.col("_hot_n").isNotNull(), F.col("_hot_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("_hot_n", "n").alias("group_size"), F.col("digest").alias("text_digest")).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_digest")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the lower half of the ids is the snapshot, the rest arrives as a new batch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    early = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    return arrivals([docs.where(early), docs.where(~early)]).withColumnRenamed("text_digest", "text_sha256")


SQL = {"op11_exact_dedup": r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
g as (select doc_id, sha256(norm) as text_sha256, min(doc_id) over (partition by norm) as keep_id,
             count(*) over (partition by norm) as group_size from t)
select doc_id, keep_id, group_size, coalesce(doc_id = keep_id, keep_id is null) as kept, text_sha256 from g
"""}
QUERIES = {"op11_exact_dedup": op11_exact_dedup}
