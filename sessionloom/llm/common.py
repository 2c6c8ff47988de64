"""Helpers shared by the operators: tables, written stages, and numpy views of Arrow text batches."""

from __future__ import annotations

from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import stage as _stage

#: While a stage is written: its shuffle files go when the write has ended, not when the driver happens to collect garbage; batches of
#: long rows are bounded by their bytes, on both sides of the Python workers. Only small tables go through the driver: an operator has
#: dozens of joins, and at Spark's own limit each of their tables may take tens of MB there.
SMALL = "256k"
STAGED = {"spark.sql.autoBroadcastJoinThreshold": SMALL, "spark.sql.adaptive.autoBroadcastJoinThreshold": SMALL,
          "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd",
          "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: Bytes of text that are worked on together: their arrays are eight times as large and several.
BLOCK = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers that start in another folder find the package where the driver has it
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def staging(spark: SparkSession):
    """The settings of ``STAGED`` while a table is written."""
    before = {key: spark.conf.get(key, None) for key in STAGED}
    off = "-1" in (before["spark.sql.autoBroadcastJoinThreshold"] or "", before["spark.sql.adaptive.autoBroadcastJoinThreshold"] or "")
    for key, value in STAGED.items():
        spark.conf.set(key, "-1" if off and value == SMALL else value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts the lineage, and frees the shuffle files behind it."""
    with staging(df.sparkSession):
        return _stage(df, name)


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session: sized with the data by whoever configures the job."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_arrays(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; nulls are empty."""
    col = batch.column(name)
    if col.null_count:
        col = col.fill_null("")
    width = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, width)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def text_blocks(batches, name: str = "text", limit: int = BLOCK):
    """``(batch slice, bytes, offsets)`` of at most ``limit`` bytes of text, or of one longer document."""
    for batch in batches:
        data, off = text_arrays(batch, name)
        at, n = 0, batch.num_rows
        while at < n:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at), data[off[at]:off[end]], off[at:end + 1] - off[at]
            at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer; wraps on purpose."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + 1)
        out = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if n > BLOCK + 1:  # one very long text: not kept
            return out[0], out[1]
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(data: np.ndarray, off: np.ndarray, separator: np.ndarray, fold: np.ndarray):
    """64-bit hashes of all words, n + 1 word offsets by document, and where each word starts and ends (its last byte).

    ``separator``: 256 booleans, bytes outside words. ``fold``: 256 bytes that replace the bytes (lower case).
    A word's hash is a polynomial of its bytes, taken from prefix sums, so no word is touched by itself.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separator[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    first, last = off[:-1][off[:-1] < off[1:]], off[1:][off[:-1] < off[1:]] - 1
    start[first] = inside[first]
    end[last] = inside[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    power, inverse = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((fold[data].astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    h = (total[e + 1] - total[s]) * inverse[s]
    return mix(h + (e - s).astype(np.uint64)), np.searchsorted(s, off), s, e


def runs(batches, key: str):
    """Rows of sorted batches as one table per value of ``key``, also where a run crosses batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(k[1:] != k[:-1]) + 1
        edges = [0, *cut.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            piece = batch.slice(a, b - a)
            if held and held[0].column(key)[0].as_py() != piece.column(key)[0].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def row_key(docs: DataFrame) -> DataFrame:
    """``(_doc, _key, _text)``: id, hash of the text, text. Rows that repeat an id with another text stay apart by the key."""
    return docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_key"), F.col("text").alias("_text"))
