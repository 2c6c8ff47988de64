"""Embedding whitening by shifted CholeskyQR.

Rows are centred exactly: with x the whole-number vectors, n their number and S their sums, the centred row is (n*x - S)/n.
Every Gram pass reads all rows, sums the products of its task's rows, and sums tasks by matrix cell. The Cholesky factor of a
Gram matrix (shifted while the rows are far from orthogonal) turns the next pass's rows through a triangular solve, and the
factors are composed: R = ... R2 R1. When the rows are orthonormal to ``CLOSE``, the singular values and right vectors of R are
those of the centred table, so no covariance is ever inverted or decomposed directly.

What reaches the driver is bounded by the dimension d, not by the rows: d sums, d*d cells a pass, at most ``PASSES`` passes.

Defined cases: rows whose vector is null, empty, or holds null, infinite or not-a-number entries are left out. Rows with null
or repeated ids stay, each as a row of its own. Vectors of several lengths, or entries too large for the whole-number scale,
are an error. Components without spread (constant or dependent dimensions) are left out, so a table of equal vectors, of one
vector, or of none gives no rows. Equal eigenvalues leave the choice of their vectors open; it is one choice for all rows.
A ``deviation`` above 2^63 - 1 is null in the query (the operator gives a decimal). Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship_package
from .common import table

#: x = floor(SCALE * c) + OFFSET
SCALE, OFFSET = 1024, 100_000
#: Gram matrices nearer to the identity than this end the passes.
CLOSE = 1e-12
PASSES = 8
#: Singular values below this part of the largest are rounding, not spread.
NOISE = 1e-10
#: Rows multiplied at a time.
ROWS = 8192
LARGEST = float(1 << 40)


@dataclass(frozen=True)
class Whitening:
    """The fit: number of rows, exact sums, and eigenvectors (columns) with their eigenvalues, largest first."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def rows(self, x: np.ndarray, k: int) -> np.ndarray:
        return _centred(x, self.n, self.sums) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))


def usable(column: str) -> Column:
    """Whether a vector has entries and all of them are finite numbers."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~bad


def _whole(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's vectors as rows of whole numbers."""
    col = batch.column(batch.num_columns - 1)
    lengths = pc.unique(pc.list_value_length(col)).to_pylist()
    if len(lengths) > 1:
        raise ValueError(f"vectors of several lengths: {sorted(lengths)[:5]}")
    flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"an entry is above {LARGEST:g}")
    return (np.floor(flat * SCALE).astype(np.int64) + OFFSET).reshape(batch.num_rows, lengths[0])


def _blocks(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            yield piece, _whole(piece)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / float(n)


def _solve(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of an upper triangle, column by column."""
    out = np.empty_like(rows)
    for j in range(upper.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def _sums(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows and exact sums by dimension."""

    def run(batches):
        n, total = 0, None
        for _, x in _blocks(batches):
            if total is not None and len(total) != x.shape[1]:
                raise ValueError(f"vectors of several lengths: {len(total)}, {x.shape[1]}")
            total = x.sum(0) if total is None else total + x.sum(0)
            n += len(x)
        if n:
            d = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(range(d)), pa.array(total), pa.array([n] * d), pa.array([d] * d)], ["i", "s", "n", "d"])

    parts = vectors.mapInArrow(run, "i long, s long, n long, d long")
    cells = parts.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
    rows = sorted(cells.collect())  # one row a dimension
    if any(r.low != r.high for r in rows):
        raise ValueError(f"vectors of several lengths: {min(r.low for r in rows)}, {max(r.high for r in rows)}")
    return (rows[0].n if rows else 0), np.asarray([r.s for r in rows], np.int64)


def _gram(vectors: DataFrame, turn, width: int) -> np.ndarray:
    """Sum over all rows of the outer product of ``turn(x)``: tasks sum their rows, then cells are summed over tasks."""

    def run(batches):
        total = np.zeros((width, width))
        for _, x in _blocks(batches):
            q = turn(x)
            total += q.T @ q
        if total.any():
            i, j = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    out = np.zeros((width, width))
    for r in vectors.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # d*d/2 cells
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def fit(vectors: DataFrame) -> Whitening:
    """Whitening of the one array column of ``vectors``, whose rows are all ``usable``."""
    ship_package(vectors.sparkSession)
    n, sums = _sums(vectors)
    gram = _gram(vectors, lambda x: _centred(x, n, sums), len(sums)) if n else np.zeros((0, 0))
    trace = float(np.trace(gram)) / max(n, 1)
    live = np.flatnonzero(np.diag(gram) > 0)  # the others are constant: no spread along them
    d = len(live)
    if not d:
        return Whitening(n, sums, np.zeros((len(sums), 0)), np.zeros(0), trace)
    gram, factors = gram[np.ix_(live, live)], []

    def turned(x, factors):
        q = _centred(x, n, sums)[:, live]
        for upper in factors:
            q = _solve(q, upper)
        return q

    while np.abs(gram - np.eye(d)).max() > CLOSE and len(factors) < PASSES:
        spread = np.linalg.eigvalsh(gram)
        unsafe = spread[0] < 0.1 * spread[-1]
        shift = 11.0 * (n * d + d * (d + 1)) * np.finfo(float).eps * spread[-1] if unsafe else 0.0
        factors.append(np.linalg.cholesky(gram + min(shift, 0.01 * spread[-1]) * np.eye(d)).T)
        done = tuple(factors)
        gram = _gram(vectors, lambda x: turned(x, done), d)
    composed = np.eye(d)
    for upper in factors:
        composed = upper @ composed
    g, e = np.linalg.eigh(gram)  # what the last pass left of the identity
    _, sigma, right = np.linalg.svd(np.sqrt(np.maximum(g, 0))[:, None] * (e.T @ composed))
    keep = sigma > NOISE * sigma[0]
    vectors_out = np.zeros((len(sums), int(keep.sum())))
    vectors_out[live] = right[keep].T
    strongest = np.abs(vectors_out).argmax(0)
    vectors_out *= np.sign(vectors_out[strongest, np.arange(vectors_out.shape[1])])
    return Whitening(n, sums, vectors_out, sigma[keep] ** 2 / n, trace)


def identity_error(vectors: DataFrame, w: Whitening, k: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""
    if not k:
        return 0.0
    gram = _gram(vectors, lambda x: np.column_stack([w.rows(x, k), np.ones(len(x))]), k + 1) / w.n
    mean = gram[k, :k]
    return float(np.abs(gram[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, w: Whitening, k: int) -> DataFrame:
    """``(vec_id, component, deviation, whitened)`` for the id and vector columns of ``rows``, by components 1 to ``k``."""
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        for batch, x in _blocks(batches):
            far = w.n * x - w.sums
            high, low = far >> 24, far & 0xFFFFFF
            parts = [(high * high).sum(1), (high * low).sum(1), (low * low).sum(1)]
            take = pa.array(np.repeat(np.arange(len(x)), k))
            component = np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), pa.array(component), *[pa.array(np.repeat(p, k)) for p in parts], pa.array(w.rows(x, k).ravel())],
                ["vec_id", "component", "_high", "_mid", "_low", "whitened"])

    out = rows.mapInArrow(run, f"vec_id {kind}, component int, _high long, _mid long, _low long, whitened double")
    exact = F.expr(f"cast(cast(_high as decimal(19,0)) * {1 << 48} + cast(_mid as decimal(19,0)) * {1 << 25} + _low as decimal(38,0))")
    return out.select("vec_id", "component", exact.alias("deviation"), "whitened")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every embedding."""
    rows = table(spark, sf_dir, "embeddings").where(usable("embedding")).select("vec_id", "embedding")
    vectors = rows.select("embedding")
    w = fit(vectors)
    k = min(8, len(w.values))
    error = identity_error(vectors, w, k)
    shares = F.create_map(*[F.lit(v) for i in range(k) for v in (i + 1, float(w.values[i] / w.trace))]) if k else F.create_map()
    explained = shares[F.col("component")] if k else F.lit(0.0)
    return whiten(rows, w, k).select(
        "vec_id", "component", F.lit(w.n).cast("long").alias("n"), F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened",
        explained.alias("explained"), F.lit(error).alias("identity_error"))


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
SQL: dict[str, str] = {}
