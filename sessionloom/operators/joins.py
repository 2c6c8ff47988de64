"""Deduplication and joins. One side of every join is reduced to one row per key first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import models as M
from ..functions.numbers import round_to
from ..schema import TOKEN_BUCKETS
from .scan import CHUNK_WIDTH, EV_WIDTH, first_seen, following, last_before, last_seen, ordered_scan

def join_key(df: DataFrame, key: str, *order: str) -> Column:
    """The key, or a value of the row's own when it is null: null keys match nothing and must not share one task."""
    return F.coalesce(F.col(key), F.concat(F.lit("\u0000"), *[F.concat(F.col(c).cast("string"), F.lit(":")) for c in order]))


def dedup_key(message_id: Column, request_id: Column, uuid: Column) -> Column:
    """``message:request`` when there is a message id, else the record id, else null."""
    return F.when(message_id != "", F.concat(message_id, F.lit(":"), F.coalesce(request_id, F.lit("")))).when(uuid != "", uuid)


def dedup_records(df: DataFrame, key: str = "dedup_key", *order: str) -> DataFrame:
    """First row of each key in file order; rows without a key all stay.

    Keeping only rank 1 lets Spark drop the other copies on the map side, so a hot key stays small.
    """
    order = order or ("file_id", "seq")
    first = Window.partitionBy(key).orderBy(*order)
    keyed = df.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return keyed.unionByName(df.filter(F.col(key).isNull()))


def max_usage(df: DataFrame, key: str = "dedup_key", *order: str) -> DataFrame:
    """Largest usage of each key over all rows, ties to the earliest."""
    order = order or ("file_id", "seq")
    best = Window.partitionBy(key).orderBy(F.desc("total"), *order)
    ranked = df.filter(F.col(key).isNotNull() & F.col("total").isNotNull()).select(key, *order, *TOKEN_BUCKETS)
    return ranked.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(key, *TOKEN_BUCKETS)


def dedup_with_max_usage(in_window: DataFrame, all_rows: DataFrame, key: str = "dedup_key", *order: str) -> DataFrame:
    """Keep-first records of the window with the usage replaced by the largest one seen at any time."""
    kept = dedup_records(in_window, key, *order)
    best = max_usage(all_rows, key, *order).select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in TOKEN_BUCKETS])
    joined = kept.withColumn("_j", join_key(kept, key, *(order or ("file_id", "seq")))).join(best, F.col("_j") == F.col("_k"), "left")
    use = F.col("total").isNotNull() & F.col("_total").isNotNull()
    swapped = {c: F.when(use, F.col(f"_{c}")).otherwise(F.col(c)) for c in TOKEN_BUCKETS}
    return joined.withColumns(swapped).select(*in_window.columns)


def tool_name_for_result(results: DataFrame, uses: DataFrame, *order: str) -> DataFrame:
    """Add the tool name of each result by call id; the last definition wins, ``(unknown)`` without one."""
    order = order or ("file_id", "seq")
    names = uses.filter(F.col("call_id").isNotNull()).groupBy(F.col("call_id").alias("_c")).agg(
        F.max_by("tool_name", F.struct(*order)).alias("_name"))
    own = join_key(results, "call_id", *[c for c in ("file_id", "seq") if c in results.columns])
    joined = results.withColumn("_j", own).join(names.hint("merge"), F.col("_j") == F.col("_c"), "left")
    return joined.withColumn("tool_name", F.coalesce("_name", F.lit("(unknown)"))).select(
        *[c for c in results.columns if c != "tool_name"], "tool_name")


def exit_code_for_output(df: DataFrame, width: int = CHUNK_WIDTH) -> DataFrame:
    """Latest earlier exit code of the same (file, call); rows carry ``event_exit`` or ``parsed_exit``."""
    seen = ordered_scan(df, ["file_id", "call_id"], "seq", [last_before("_e", F.col("event_exit"))], width)
    outcome = F.coalesce(F.col("_e"), F.col("parsed_exit"))
    return seen.filter(F.col("is_output")).withColumn("exit_code", outcome).withColumn(
        "is_error", F.coalesce(outcome != 0, F.lit(False))).drop("_e")


def with_session_source(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Left join of per-session sources (one row per session)."""
    return df.drop("source").join(sources, "session_id", "left")


def carry_state(df: DataFrame, width: int = CHUNK_WIDTH, per_file: DataFrame | None = None) -> DataFrame:
    """Carry model and repo down each file (last seen) and take the first session id and source of it; ``per_file`` adds its columns."""
    specs = [
        last_seen("cur_model", F.when(F.col("set_model") != "", F.col("set_model"))),
        last_seen("cur_repo", F.when(F.col("set_repo") != "", F.col("set_repo"))),
        first_seen("cur_session", F.when(F.col("set_session") != "", F.col("set_session"))),
        first_seen("cur_source", F.when(F.col("set_source") != "", F.col("set_source"))),
    ]
    return ordered_scan(df, ["file_id"], "seq", specs, width, per_file)


def file_plan(df: DataFrame, plan: str = "plan") -> DataFrame:
    """First non-empty plan label of each file, whatever the window."""
    rows = df.filter(F.col(plan) != "")
    return rows.groupBy("file_id").agg(F.min_by(plan, "seq").alias("plan"))


def flag_subagent_files(records: DataFrame) -> DataFrame:
    """file_id, is_sidechain from the first header of each file; the working directory is not searched."""
    headers = records.filter(F.col("type") == "session_meta").groupBy("file_id").agg(
        F.min_by(F.to_json("payload"), "seq").alias("_p"))
    fields = F.map_filter(F.from_json("_p", "map<string,string>"), lambda k, v: k != "cwd")
    probe = F.to_json(fields)
    return headers.select("file_id", F.coalesce(F.contains(probe, F.lit("subagent")) | F.contains(probe, F.lit("thread_spawn")),
                                                F.lit(False)).alias("is_sidechain"))


def lookup_price(models: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Longest-prefix price of each distinct model as an equi-join on the prefixes of the model names.

    ``prices`` has prefix, input, cached_input, output, cache_creation. Distinct models are few and short, so
    expanding their prefixes is cheap and no pair of tables is compared row by row.
    """
    distinct = models.select(model).distinct().withColumn("_m", M.normalize_model(F.col(model)))
    prefixes = distinct.withColumn("_n", F.explode(F.sequence(F.lit(1), F.greatest(F.length("_m"), F.lit(1)))))
    prefixes = prefixes.withColumn("prefix", F.expr("substring(_m, 1, _n)"))
    hit = prefixes.join(prices, "prefix")
    cols = [c for c in prices.columns]
    best = hit.groupBy(model).agg(F.max_by(F.struct(*cols), "_n").alias("price"))
    return distinct.select(model).join(best, model, "left")


def apply_official_prices(models: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per model: exact name, else any-case name, else the carried fallback cost, flagged.

    ``models`` has token buckets and ``cost_usd``; ``prices`` has name and dollar rates per million tokens.
    Costs are decimal sums rounded to 4 digits.
    """
    rates = ("input", "cached_input", "output", "cache_creation")
    exact = prices.select(F.col("name").alias("_n"), F.struct(*rates).alias("_exact"))
    folded = prices.groupBy(F.lower("name").alias("_l")).agg(F.min_by(F.struct(*rates), "name").alias("_any"))
    live = models.filter(F.col("total") > 0)
    j = live.join(exact, F.col("model") == F.col("_n"), "left").join(folded, F.lower("model") == F.col("_l"), "left")
    j = j.withColumn("_p", F.coalesce("_exact", "_any"))
    p = F.col("_p")

    def times(tokens: Column, rate: Column) -> Column:
        return tokens.cast("decimal(20,0)") * rate.cast("decimal(12,6)")

    cached = F.least("cached_input", "input")
    plain = times(F.col("input") - cached, p["input"]) + times(cached, p["cached_input"]) + times(F.col("output"), p["output"])
    full = (times(F.col("input"), p["input"]) + times(F.col("cached_input"), p["cached_input"])
            + times(F.col("cache_creation"), p["cache_creation"]) + times(F.col("output"), p["output"]))
    official = F.when(p["cache_creation"].isNotNull(), full).otherwise(plain).cast("double") / F.lit(1e6)
    found = p.isNotNull()
    return j.select(*models.columns, found.alias("official"), round_to(F.when(found, official).otherwise(F.col("cost_usd")), 4)
                    .alias("cost")).drop("cost_usd")


def platform_cost(priced: DataFrame) -> DataFrame:
    """Cost per platform with the all-priced flag; costs are summed as 4-digit decimals."""
    per = priced.groupBy("platform").agg(
        F.sum(F.round(F.col("cost") * 10000).cast("bigint")).alias("t"), F.bool_and("official").alias("all_priced"),
        F.count(F.when(~F.col("official"), F.lit(1))).alias("unpriced_models"))
    return per.select("platform", round_to(F.col("t").cast("double") / F.lit(10000.0), 2).alias("cost_usd"), "all_priced", "unpriced_models")


#: Cells of the interval join: an hour at level 0, doubled with each level.
CELL_SECONDS = 3_600
TOP_LEVEL = 14
#: Cells from this level on are dealt over up to ``SPREAD`` parts, since a busy repository may put many commits into one.
WIDE_LEVEL, SPREAD = 7, 8


def _parts(level: Column) -> Column:
    """Parts of a cell: one below ``WIDE_LEVEL``, then twice as many with each level, up to ``SPREAD``."""
    return F.least(F.lit(SPREAD), F.pow(F.lit(2.0), F.greatest(F.lit(0), level - WIDE_LEVEL + 1)).cast("int"))


def commits_in_session(sessions: DataFrame, commits: DataFrame) -> DataFrame:
    """Commits of the same repository inside each session's [first, last].

    Time is cut into dyadic cells. A session lies in the one or two cells of the level whose cells are at least as long as it
    (a few more beyond the top level of almost two years), and a commit shows up once per level that any session has. Both
    meet on (repo, level, cell, part): commits of wide cells are dealt over parts, which a session visits all. So a
    year-long session makes at most sixteen rows, and no full cross of sessions and commits is formed.
    """
    micros = lambda ts: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))
    hours = F.ceil((micros("last_ts") - micros("first_ts")) / (CELL_SECONDS * 1_000_000))
    level = F.least(F.lit(TOP_LEVEL), F.ceil(F.log2(F.greatest(hours, F.lit(1).cast("bigint"))))).cast("int")

    def cell(ts: str, at: Column) -> Column:
        return F.floor(micros(ts) / (F.lit(CELL_SECONDS * 1_000_000) * F.pow(F.lit(2.0), at))).cast("bigint")

    valid = sessions.filter(F.col("first_ts") <= F.col("last_ts")).withColumn("_level", level)
    left = valid.select("*", F.explode(F.sequence(cell("first_ts", F.col("_level")), cell("last_ts", F.col("_level")))).alias("_cell"))
    left = left.select("*", F.explode(F.sequence(F.lit(0), _parts(F.col("_level")) - 1)).alias("_part"))
    present = [r[0] for r in valid.select("_level").distinct().collect()]  # at most fifteen levels
    levels = F.array(*[F.lit(n) for n in sorted(present)]).cast("array<int>")
    right = commits.select("*", F.explode(levels).alias("_level"))
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in commits.columns]), _parts(F.col("_level"))).cast("int")
    right = right.select("*", cell("commit_ts", F.col("_level")).alias("_cell"), part.alias("_part"))
    joined = left.join(right, ["repo", "_level", "_cell", "_part"])
    return joined.filter(F.col("commit_ts").between(F.col("first_ts"), F.col("last_ts"))).drop("_level", "_cell", "_part")


def reconcile(ours: DataFrame, theirs: DataFrame, keys: list[str], tol: float = 0.01) -> DataFrame:
    """Tokens equal and cost within ``tol``; a key missing on one side is ``skipped``. Inputs: keys, tokens, cost."""
    a = ours.select(*keys, F.col("tokens").alias("our_tokens"), F.col("cost").alias("our_cost"))
    b = theirs.select(*keys, F.col("tokens").alias("their_tokens"), F.col("cost").alias("their_cost"))
    off = F.abs(F.col("our_cost") - F.col("their_cost")) / F.greatest(F.abs("their_cost"), F.lit(1e-9))
    same = (F.col("our_tokens") == F.col("their_tokens")) & (off <= F.lit(tol))
    status = (
        F.when(F.col("our_tokens").isNull() | F.col("their_tokens").isNull(), F.lit("skipped"))
        .when(same, F.lit("ok")).otherwise(F.lit("fail"))
    )
    return a.join(b, keys, "full_outer").withColumn("status", status)


def session_prompts(ev: DataFrame, selected: DataFrame) -> DataFrame:
    """Prompts of the selected sessions."""
    prompts = ev.filter((F.col("kind") == "prompt") & ~F.col("is_sidechain"))
    return prompts.join(selected.select("session_id"), "session_id", "left_semi")


def corrected_by_next(boundaries: DataFrame, width: int = EV_WIDTH) -> DataFrame:
    """Add whether the next boundary of the same file opens with a correction."""
    scanned = ordered_scan(boundaries, ["file_id"], "seq", [following("_c", F.col("is_correction"))], width)
    return scanned.withColumn("corrected_by_next", F.coalesce("_c", F.lit(False))).drop("_c")
