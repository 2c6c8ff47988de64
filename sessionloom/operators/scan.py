"""Ordered running state that survives hot keys.

A plain ``Window.partitionBy(key).orderBy(position)`` sorts one key in one task; one file or session may hold a
third of all rows. Here a key is cut into chunks of bounded position range. Each chunk runs its own window, a
small table with one row per (key, chunk) carries the state from chunk to chunk, and one equi-join adds the
carried state back. The result does not depend on the chunk width.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import STRIDE

# Positions per chunk where positions are line numbers, counts or values: this bounds the rows of a chunk.
CHUNK_WIDTH = 262_144
# The same for positions of ``ev``, which are lines times STRIDE: the facts of so many lines make a chunk.
EV_WIDTH = 4_096 * STRIDE


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is sum, max, last, first, last_before, lag or lead.

    sum, max, last and first include the current row; last_before is the last non-null value strictly before it;
    lag and lead are the neighbouring rows' values, null or not.
    """

    name: str
    kind: str
    value: Column


def running_sum(name: str, value: Column) -> Running:
    return Running(name, "sum", value)


def running_count(name: str, condition: Column) -> Running:
    return Running(name, "sum", F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))


def last_seen(name: str, value: Column) -> Running:
    return Running(name, "last", value)


def last_before(name: str, value: Column) -> Running:
    return Running(name, "last_before", value)


def first_seen(name: str, value: Column) -> Running:
    return Running(name, "first", value)


def previous(name: str, value: Column) -> Running:
    return Running(name, "lag", value)


def following(name: str, value: Column) -> Running:
    return Running(name, "lead", value)


def ordered_scan(df: DataFrame, keys: list[str], order: str, specs: list[Running], width: int = CHUNK_WIDTH, per_key: DataFrame | None = None) -> DataFrame:
    """Add the running values of ``specs`` over rows of equal ``keys`` in ascending ``order``.

    ``order`` is a non-negative whole number, unique within its key. ``per_key`` has one row for each key; its other columns
    are added to all rows of the key.
    """
    if not specs:
        return df
    # One key column for the windows and the join, so the rows are shuffled and sorted once; nulls are equal inside a struct.
    cut = df.withColumn("_at", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.expr(f"`{order}` div {int(width)}").alias("chunk")))
    pos = F.col(order)
    here = Window.partitionBy("_at").orderBy(order)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    chunks = Window.partitionBy(*[f"_key.k{i}" for i in range(len(keys))]).orderBy("_key.chunk")
    chunks_before = chunks.rowsBetween(Window.unboundedPreceding, -1)

    local, summary, carry, result = [], [], [], []
    for i, s in enumerate(specs):
        v, a, b, c = s.value, f"_l{i}", f"_s{i}", f"_c{i}"
        if s.kind == "sum":
            local.append(F.sum(v).over(upto).alias(a))
            summary.append(F.sum(v).alias(b))
            carry.append(F.sum(b).over(chunks_before).alias(c))
            zero = F.lit(0)
            result.append((F.coalesce(F.col(a), zero) + F.coalesce(F.col(c), zero)).alias(s.name))
        elif s.kind == "max":
            local.append(F.max(v).over(upto).alias(a))
            summary.append(F.max(v).alias(b))
            carry.append(F.max(b).over(chunks_before).alias(c))
            result.append(F.greatest(F.col(a), F.col(c)).alias(s.name))
        elif s.kind in ("last", "last_before"):
            local.append(F.last(v, True).over(upto if s.kind == "last" else before).alias(a))
            summary.append(F.max_by(v, F.when(v.isNotNull(), pos)).alias(b))
            carry.append(F.last(b, True).over(chunks_before).alias(c))
            result.append(F.coalesce(F.col(a), F.col(c)).alias(s.name))
        elif s.kind == "first":
            local.append(F.first(v, True).over(upto).alias(a))
            summary.append(F.min_by(v, F.when(v.isNotNull(), pos)).alias(b))
            carry.append(F.first(b, True).over(chunks_before).alias(c))
            result.append(F.coalesce(F.col(c), F.col(a)).alias(s.name))
        elif s.kind in ("lag", "lead"):
            # A neighbour inside the chunk is recognized by its position, so a null value needs no wrapper.
            shift, pick = (F.lag, F.max_by) if s.kind == "lag" else (F.lead, F.min_by)
            local += [shift(v).over(here).alias(a), shift(pos).over(here).alias(f"_n{i}")]
            summary.append(pick(v, pos).alias(b))
            carry.append(shift(b).over(chunks).alias(c))
            result.append(F.when(F.col(f"_n{i}").isNotNull(), F.col(a)).otherwise(F.col(c)).alias(s.name))
        else:
            raise ValueError(f"unknown running kind {s.kind!r}")

    rows = cut.select("*", *local)
    carried = cut.groupBy(F.col("_at").alias("_key")).agg(*summary).select("_key", *carry)
    known = [] if per_key is None else [c for c in per_key.columns if c not in keys]
    if known:
        # the small table takes the columns to the rows, which need no shuffle of their own for them
        own = per_key.select(*[F.col(k).alias(f"_p{i}") for i, k in enumerate(keys)], *known).hint("merge")
        here = [F.col(f"_key.k{i}") == F.col(f"_p{i}") for i in range(len(keys))]
        carried = carried.join(own, here, "left").select("_key", *[f"_c{i}" for i in range(len(specs))], *known)
    # The chunks grow with the rows, and their size is guessed too low where long columns were left out: they never go through the driver.
    both = rows.join(carried.hint("merge"), F.col("_at") == F.col("_key"), "left").withColumns(
        {f"_c{i}": F.when(pos.isNotNull(), F.col(f"_c{i}")) for i in range(len(specs))})
    return both.select(*[F.col(c) for c in df.columns], *result, *known)


def quantiles(df: DataFrame, keys: list[str], value: str, picks: dict[str, tuple[str, float]], width: int = CHUNK_WIDTH) -> DataFrame:
    """Exact quantiles of a whole-number column, all keys and all picks at once: ``keys``, ``rows`` and one column a pick.

    A pick is ("nearest", q) for the value at rank ceil(q * n) counted from 1, or ("index", q) for index floor(q * n) counted from 0.
    Equal values are counted first. A histogram with one row per (key, cell of ``width`` values) says which cell holds each rank,
    and only the counts of those cells are sorted, so neither a hot key nor a hot value meets in one task. Null values don't count;
    a key with null values only has no row.
    """
    rules = {"nearest": lambda q: F.ceil(F.lit(q) * F.col("rows")), "index": lambda q: F.least(F.floor(F.col("rows") * F.lit(q)), F.col("rows") - 1) + 1}
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    groups = [f"_k{i}" for i in range(len(keys))]
    counts = df.filter(F.col(value).isNotNull()).groupBy(*named, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_cell", F.expr(f"_v div {int(width)}"))
    upto = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = counts.groupBy(*groups, "_cell").agg(F.sum("_n").alias("_in")).select(
        *groups, "_cell", "_in", F.sum("_in").over(upto).alias("_upto"), F.sum("_in").over(Window.partitionBy(*groups)).alias("rows"))
    ranks = F.array(*[F.struct(F.lit(name).alias("pick"), rules[rule](q).cast("bigint").alias("rank")) for name, (rule, q) in picks.items()])
    before = F.col("_upto") - F.col("_in")
    here = cells.select("*", F.explode(ranks).alias("_r")).filter((F.col("_r.rank") > before) & (F.col("_r.rank") <= F.col("_upto")))
    targets = here.select(*[F.col(g).alias(f"_t{g}") for g in groups], F.col("_cell").alias("_t_cell"), "rows", "_r.pick", (F.col("_r.rank") - before).alias("_rank"))
    same = F.col("_cell") == F.col("_t_cell")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_t{g}"))
    run = F.sum("_n").over(Window.partitionBy(*groups, "_cell", "pick").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = counts.join(targets, same).withColumn("_run", run).filter((F.col("_run") >= F.col("_rank")) & (F.col("_run") - F.col("_n") < F.col("_rank")))
    out = found.groupBy(*groups).agg(F.first("rows").alias("rows"), *[F.max(F.when(F.col("pick") == name, F.col("_v"))).alias(name) for name in picks])
    return out.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], "rows", *picks)
