"""Episodes: one instruction to the next. Segmentation, features, loop signals, summaries.

Every per-episode measure is first summed per (episode, facet), where a facet is a model, a file or a run of
results; the second aggregation then folds facets into one row per episode. Nothing collects the rows of an episode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import models as M
from ..functions.numbers import count_true, ratio, ratio4, round_to
from ..functions.timez import epoch_micros
from ..schema import TOKEN_BUCKETS
from ..session import stage
from .filters import main_only, nonempty_episodes
from .scan import CHUNK_WIDTH, EV_WIDTH, following, last_before, last_seen, ordered_scan, previous, quantiles, running_count, running_sum

# Thresholds of the loop signals.
EDIT_RING_MIN = 3
ERROR_RUN_MIN = 3
ERROR_RATE_MIN = 0.5
ERROR_RESULTS_MIN = 4
ERROR_FILES_MAX = 3
NO_PROGRESS_MIN = 4
TIME_FLOOR_MS = 300_000
MIN_SAMPLES = 5
IDLE_CAP_SECONDS = 300
DOC_EXTENSIONS = ["md", "mdx", "rst", "txt"]
KEY = ["file_id", "ep"]


def boundaries(ev: DataFrame, width: int = EV_WIDTH) -> DataFrame:
    """One row per episode start: episode number in its file, index in its session, correction by the next one.

    The session index counts over files in path order: rank within (file, session) plus the starts of the
    session's earlier files.
    """
    rows = main_only(ev).filter(F.col("is_boundary")).select(
        "file_id", "seq", "ts", "platform",
        *[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit("(unknown)")).otherwise(F.col(c)).alias(c) for c in ("session_id", "repo")],
        F.coalesce("is_correction", F.lit(False)).alias("is_correction"),
        F.coalesce("is_thinking", F.lit(False)).alias("thinking_directive"))
    # One row per episode: small next to the events, so it is written once and the scans below read that.
    rows = stage(rows, "boundaries")
    numbered = ordered_scan(rows, ["file_id"], "seq", [
        running_sum("ep", F.lit(1).cast("bigint")), following("_c", F.col("is_correction"))], width)
    numbered = numbered.withColumn("corrected_by_next", F.coalesce("_c", F.lit(False))).drop("_c")
    ranked = ordered_scan(numbered, ["file_id", "session_id"], "seq", [running_sum("_rank", F.lit(1).cast("bigint"))], width)
    earlier = Window.partitionBy("session_id").orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("session_id", "file_id").agg(F.count(F.lit(1)).alias("n")).select(
        "session_id", "file_id", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_offset"))
    return ranked.join(offsets, ["session_id", "file_id"]).select(
        "file_id", "ep", F.col("seq").alias("start_seq"), F.col("ts").alias("start_ts"), "platform", "session_id", "repo",
        (F.col("_rank") - 1 + F.col("_offset")).alias("index"), "is_correction", "thinking_directive", "corrected_by_next")


def label_episodes(ev: DataFrame, cap_seconds: int = IDLE_CAP_SECONDS, width: int = EV_WIDTH) -> DataFrame:
    """Main-chain rows with their episode number and running positions; rows before the first start are dropped."""
    rows = main_only(ev)
    used = F.col("total").isNotNull()
    scanned = ordered_scan(rows, ["file_id"], "seq", [
        running_count("ep", F.coalesce(F.col("is_boundary"), F.lit(False))),
        last_seen("_start", F.when(F.col("is_boundary"), F.col("seq"))),
        running_count("ok_results", (F.col("kind") == "tool_result") & ~F.coalesce(F.col("is_error"), F.lit(False))),
        running_count("calls_so_far", F.col("kind") == "tool_call"),
        last_before("_active_ts", F.when(used, F.col("ts"))), last_before("_active_seq", F.when(used, F.col("seq"))),
    ], width)
    gap = epoch_micros(F.col("ts")) - epoch_micros(F.col("_active_ts"))
    counts = used & (F.col("_active_seq") >= F.col("_start")) & (gap > 0) & (gap <= cap_seconds * 1_000_000)
    return scanned.withColumn("gap_micros", F.when(counts, gap).otherwise(F.lit(0).cast("bigint"))).filter(F.col("ep") > 0).drop(
        "_start", "_active_ts", "_active_seq")


def episode_facets(labelled: DataFrame) -> DataFrame:
    """Sums per (episode, facet, key): facet is model, file, run (results between two successes), effort or rest.

    All buffers are numbers, so both sides of the shuffle use hash aggregation.
    """
    kind, base = F.col("kind"), F.coalesce(F.col("file_base"), F.lit(""))
    call = kind == "tool_call"
    on_file = call & (F.col("tool_kind") == "file") & (base != "")
    used = F.col("total").isNotNull()
    result = kind == "tool_result"
    error = result & F.coalesce(F.col("is_error"), F.lit(False))
    edit = F.coalesce(F.col("is_edit"), F.lit(False))
    doc = F.col("file_ext").isin(DOC_EXTENSIONS)
    effort = (kind == "label") & (F.col("label_field") == "effort")
    facet = (F.when(used, F.lit("model")).when(on_file, F.lit("file")).when(result, F.lit("run"))
             .when(effort, F.lit("effort")).otherwise(F.lit("rest")))
    key = (F.when(used, M.normalize_model(F.col("model"))).when(on_file, base)
           .when(result, F.col("ok_results").cast("string")).when(effort, F.col("label")).otherwise(F.lit("")))
    tool_kind = F.col("tool_kind")
    rows = labelled.withColumns({
        "facet": facet, "facet_key": key, "uncached": M.uncached_input(F.col("input"), F.col("cached_input"))})
    return rows.groupBy(*KEY, "facet", "facet_key").agg(
        *[F.sum(c).alias(c) for c in (*TOKEN_BUCKETS, "uncached")],
        F.sum("gap_micros").alias("gap_micros"), F.max(F.when(used, F.col("ts"))).alias("last_ts"),
        count_true(call).alias("tool_calls"), count_true(on_file & edit).alias("edits"),
        count_true(on_file & ~edit).alias("reads"), count_true(call & (tool_kind == "shell")).alias("shells"),
        count_true(call & (tool_kind == "search")).alias("searches"),
        count_true(call & ~on_file & ~tool_kind.isin("shell", "search", "web")).alias("others"),
        count_true(on_file & doc).alias("doc_files"),
        count_true(on_file & ~doc & (F.coalesce(F.col("file_ext"), F.lit("")) != "")).alias("code_files"),
        count_true(on_file).alias("file_calls"),
        count_true(result).alias("results"), count_true(error).alias("errors"),
        count_true(error & (F.col("error_category") == "test")).alias("test_results"),
        count_true(call & F.coalesce(F.col("long_run"), F.lit(False))).alias("long_runs"),
        F.sum(F.coalesce(F.col("lines_added") + F.col("lines_removed"), F.lit(0))).alias("lines"),
        count_true(kind == "interrupt").alias("interrupts"), count_true(kind == "compaction").alias("compactions"),
        F.max("seq").alias("last_seq"),
        F.min(F.when(call, F.col("calls_so_far"))).alias("first_call"), F.max(F.when(call, F.col("calls_so_far"))).alias("last_call"))


def quiet_runs(facets: DataFrame, width: int = CHUNK_WIDTH) -> DataFrame:
    """Longest run of calls that touch no new file, per episode.

    A file's first touch is the smallest call position of its facet; the run lengths are the gaps between
    neighbouring first touches, with one virtual touch before the first call and one after the last.
    """
    touches = facets.filter(F.col("facet") == "file").select(*KEY, F.col("first_call").alias("pos"))
    ends = facets.filter(F.col("first_call").isNotNull()).groupBy(*KEY).agg(
        F.min("first_call").alias("a"), F.max("last_call").alias("b"))
    both = ends.select(*KEY, F.explode(F.array(F.col("a") - 1, F.col("b") + 1)).alias("pos"))
    seen = ordered_scan(touches.unionByName(both), KEY, "pos", [previous("_p", F.col("pos"))], width)
    return seen.groupBy(*KEY).agg(F.max(F.coalesce(F.col("pos") - F.col("_p") - 1, F.lit(0))).alias("quiet_run"))


def episode_features(facets: DataFrame) -> DataFrame:
    """One row per episode with its summed features."""
    price = M.price_of(F.col("facet_key"))
    nano = M.cost_nano(price, *[F.coalesce(F.col(c), F.lit(0)) for c in ("input", "cached_input", "cache_creation", "output", "uncached")])
    is_model = F.col("facet") == "model"
    rows = facets.withColumn("nano", F.when(is_model, nano).otherwise(F.lit(0).cast("decimal(36,0)")))
    top_model = F.min(F.when(is_model & (F.col("facet_key") != ""), F.struct((-F.col("total")).alias("t"), "facet_key")))
    summed = ("tool_calls", "reads", "edits", "searches", "shells", "others", "doc_files", "code_files", "file_calls", "results",
              "errors", "test_results", "long_runs", "lines", "interrupts", "compactions", "gap_micros")
    agg = rows.groupBy(*KEY).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*TOKEN_BUCKETS, *summed)],
        F.max("last_ts").alias("last_ts"), F.sum("nano").alias("nano"), top_model["facet_key"].alias("model"),
        F.max_by("facet_key", F.when(F.col("facet") == "effort", F.col("last_seq"))).alias("effort"),
        count_true(F.col("facet") == "file").alias("files_touched"),
        F.coalesce(F.max(F.when(F.col("facet") == "file", F.col("edits"))), F.lit(0)).alias("max_edits_per_file"),
        F.coalesce(F.max(F.when(F.col("facet") == "run", F.col("errors"))), F.lit(0)).alias("error_run"))
    return agg.withColumns({
        "active_ms": F.floor(F.col("gap_micros") / 1000).cast("bigint"),
        "has_test": F.col("test_results") > 0, "long_run": F.col("long_runs") > 0,
        "doc_ratio": ratio(F.col("doc_files"), F.col("file_calls")), "code_ratio": ratio(F.col("code_files"), F.col("file_calls")),
        "error_rate_raw": ratio(F.col("errors"), F.col("results")),
        "interrupted": F.col("interrupts") > 0, "compacted": F.col("compactions") > 0,
        "cost_usd": M.nano_to_usd(F.col("nano"))})


TASK_RULES = ("docs", "experiment", "debug", "refactor", "implement", "explore", "scripting")


def task_scores() -> dict[str, Column]:
    """Score of each task rule on the feature columns; 0 when the rule does not apply."""
    c = F.col
    total = c("reads") + c("edits") + c("searches") + c("shells") + c("others")
    readish = c("reads") + c("searches")
    zero = F.lit(0.0)

    def bonus(value: Column, per: float, cap: float) -> Column:
        return F.least(F.lit(cap), value.cast("double") / F.lit(per))

    return {
        "docs": F.when((c("doc_ratio") >= 0.6) & (c("edits") > 0), F.lit(0.6) + c("doc_ratio") * F.lit(0.4)).otherwise(zero),
        "experiment": F.when(c("long_run"), F.lit(0.7) + F.when(c("edits") == 0, F.lit(0.2)).otherwise(zero)).otherwise(zero),
        "debug": F.when((c("error_rate_raw") >= 0.4) & (c("edits") > 0) & (c("files_touched") <= 3),
                        F.lit(0.5) + c("error_rate_raw") * F.lit(0.4)).otherwise(zero),
        "refactor": F.when((c("files_touched") >= 6) & ((c("lines") >= 400) | (c("edits") >= 10)),
                           F.lit(0.7) + bonus(c("files_touched"), 40.0, 0.3)).otherwise(zero),
        "implement": F.when((c("edits") >= 3) & (c("has_test") | (c("code_ratio") >= 0.5)),
                            F.lit(0.5) + bonus(c("edits"), 25.0, 0.4)).otherwise(zero),
        "explore": F.when((readish >= 4) & (c("edits") <= 1), F.lit(0.5) + bonus(readish, 25.0, 0.4)).otherwise(zero),
        "scripting": F.when((c("edits") >= 1) & ~c("has_test") & (total <= 6) & (c("files_touched") <= 2), F.lit(0.45)).otherwise(zero),
    }


def with_task_type(episodes: DataFrame) -> DataFrame:
    """Best scored rule; below 0.4 or with fewer than two actions the type is unknown."""
    c = F.col
    scored = episodes.withColumns({f"_s_{k}": v for k, v in task_scores().items()})
    best = F.greatest(*[c(f"_s_{k}") for k in TASK_RULES])
    few = c("reads") + c("edits") + c("searches") + c("shells") + c("others") < 2
    name = F.when(few | (best < 0.4), F.lit("unknown"))
    for k in TASK_RULES:
        name = name.when(c(f"_s_{k}") == best, F.lit(k))
    confidence = F.when(few, F.lit(0.1)).when(best < 0.4, F.least(F.lit(0.39), best)).otherwise(F.least(F.lit(1.0), best))
    return scored.withColumns({"task_type": name, "task_type_confidence": round_to(confidence, 2)}).drop(*[f"_s_{k}" for k in TASK_RULES])


def nearest_rank(df: DataFrame, keys: list[str], value: str, q: float, width: int = CHUNK_WIDTH) -> DataFrame:
    """Exact nearest-rank quantile per key, with the row count."""
    return quantiles(df, keys, value, {"q_value": ("nearest", q)}, width).select(*keys, "q_value", "rows")


def time_outlier(episodes: DataFrame, width: int = CHUNK_WIDTH) -> DataFrame:
    """Longer than the p90 of its task type and than the floor; small types use the global p90, flagged."""
    # One pass for the types and for all episodes, which count under the key "*".
    keyed = episodes.select(F.explode(F.array(F.col("task_type"), F.lit("*"))).alias("_key"), "active_ms")
    limits = nearest_rank(keyed, ["_key"], "active_ms", 0.9, width)
    overall = F.max(F.when(F.col("_key") == "*", F.col("q_value"))).over(Window.partitionBy())
    # At most one row per task label: bounded by the fixed label list.
    by_type = limits.select("_key", F.col("q_value").alias("_type_p90"), F.col("rows").alias("_type_rows"), overall.alias("_p90"))
    out = episodes.join(F.broadcast(by_type), episodes["task_type"] == by_type["_key"])
    low = F.col("_type_rows") < MIN_SAMPLES
    limit = F.when(low, F.col("_p90")).otherwise(F.col("_type_p90"))
    return out.withColumns({
        "time_outlier": (F.col("active_ms") > limit) & (F.col("active_ms") > TIME_FLOOR_MS), "low_confidence": low,
    }).select(*episodes.columns, "time_outlier", "low_confidence")


def with_spiral(episodes: DataFrame) -> DataFrame:
    c = F.col
    dense = (c("error_run") >= ERROR_RUN_MIN) | (
        (c("error_rate_raw") >= ERROR_RATE_MIN) & (c("results") >= ERROR_RESULTS_MIN) & (c("files_touched") <= ERROR_FILES_MAX))
    return episodes.withColumns({
        "edit_ring": c("max_edits_per_file") >= EDIT_RING_MIN, "error_dense": dense,
        "no_progress": (c("quiet_run") >= NO_PROGRESS_MIN) & ((c("edits") > 0) | (c("errors") > 0))})


def with_severity(episodes: DataFrame) -> DataFrame:
    def n(name: str) -> Column:
        return F.col(name).cast("int")

    return episodes.withColumn("severity", n("edit_ring") * 2 + n("error_dense") * 2 + n("no_progress") + n("time_outlier"))


def with_end_type(episodes: DataFrame) -> DataFrame:
    end = F.when(F.col("interrupted"), F.lit("interrupted")).when(F.col("corrected_by_next"), F.lit("corrected")).otherwise(F.lit("natural"))
    return episodes.withColumn("end_type", end)


DETAIL_COLUMNS = [
    "file_id", "ep", "platform", "session_id", "repo", "index", "start_ts", "end_ts", "duration_seconds", *TOKEN_BUCKETS, "cost_usd",
    "tool_calls", "files_touched", "max_edits_per_file", "error_count", "error_rate", "interrupted", "end_type", "task_type",
    "task_type_confidence", "edit_ring", "error_dense", "no_progress", "time_outlier", "low_confidence", "severity", "effort", "model",
    "thinking_directive", "compacted",
]


def raw_episodes(ev: DataFrame, cap_seconds: int = IDLE_CAP_SECONDS, width: int = EV_WIDTH) -> DataFrame:
    """One row per non-empty episode with features, before the comparisons between episodes."""
    facets = stage(episode_facets(label_episodes(ev, cap_seconds, width)), "facets")
    rows = boundaries(ev, width).join(episode_features(facets), KEY).join(quiet_runs(facets, min(width, CHUNK_WIDTH)), KEY, "left")
    rows = rows.withColumn("quiet_run", F.coalesce("quiet_run", F.lit(0)))
    return with_end_type(with_spiral(with_task_type(nonempty_episodes(rows))))


def episode_detail(ev: DataFrame, cap_seconds: int = IDLE_CAP_SECONDS, width: int = EV_WIDTH) -> DataFrame:
    """The full episode table: counts, flags and labels only."""
    return finished(stage(raw_episodes(ev, cap_seconds, width), "episodes"), min(width, CHUNK_WIDTH))


def finished(rows: DataFrame, width: int = CHUNK_WIDTH) -> DataFrame:
    """Raw episodes compared with each other. Several readers should read one written copy."""
    full = with_severity(time_outlier(rows, width))
    return full.withColumns({
        "end_ts": F.greatest("start_ts", "last_ts"), "duration_seconds": F.floor(F.col("active_ms") / 1000).cast("bigint"),
        "error_count": F.col("errors"), "error_rate": round_to(F.col("error_rate_raw"), 4)}).select(*DETAIL_COLUMNS)


def error_runs(ev: DataFrame, width: int = EV_WIDTH) -> DataFrame:
    """Longest run of consecutive failed results per episode."""
    rows = label_episodes(ev, width=width).filter(F.col("kind") == "tool_result")
    runs = rows.groupBy(*KEY, "ok_results").agg(count_true(F.coalesce(F.col("is_error"), F.lit(False))).alias("n"))
    return runs.groupBy(*KEY).agg(F.max("n").alias("error_run"))


def edit_stats(ev: DataFrame, width: int = EV_WIDTH) -> DataFrame:
    """Largest edit count of one file and distinct files per episode."""
    rows = label_episodes(ev, width=width).filter((F.col("kind") == "tool_call") & (F.col("tool_kind") == "file") & (F.col("file_base") != ""))
    per_file = rows.groupBy(*KEY, "file_base").agg(count_true(F.coalesce(F.col("is_edit"), F.lit(False))).alias("n"))
    return per_file.groupBy(*KEY).agg(F.max("n").alias("max_edits_per_file"), F.count(F.lit(1)).alias("files_touched"))


def dominant_model(ev: DataFrame, width: int = EV_WIDTH) -> DataFrame:
    rows = label_episodes(ev, width=width).filter(F.col("total").isNotNull())
    per = rows.groupBy(*KEY, M.normalize_model(F.col("model")).alias("model")).agg(F.sum("total").alias("t")).filter(F.col("model") != "")
    return per.groupBy(*KEY).agg(F.min(F.struct((-F.col("t")).alias("t"), "model"))["model"].alias("model"))


def episode_summary(episodes: DataFrame, *keys: str) -> DataFrame:
    """Counts, rates and the intervention style."""
    n = F.count(F.lit(1))
    interrupted, corrected = count_true(F.col("interrupted")), count_true(F.col("end_type") == "corrected")
    base = episodes.groupBy(*keys).agg(
        n.alias("episodes"), ratio(interrupted, n).alias("_i"), ratio(corrected, n).alias("_c"),
        count_true(F.col("severity") > 0).alias("spiral_episodes"))
    both = F.col("_i") + F.col("_c")
    style = F.when(both >= 0.35, F.lit("micro-manager")).when(both <= 0.1, F.lit("free-range")).otherwise(F.lit("balanced"))
    return base.select(
        *keys, "episodes", round_to(F.lit(1.0) - F.col("_i"), 4).alias("autonomy_rate"), round_to(F.col("_i"), 4).alias("interrupted_rate"),
        round_to(F.col("_c"), 4).alias("corrected_rate"), style.alias("intervention_style"), "spiral_episodes")


def task_mix(episodes: DataFrame) -> DataFrame:
    counts = episodes.groupBy("task_type").agg(F.count(F.lit(1)).alias("episodes"))
    total = F.sum("episodes").over(Window.partitionBy())  # one row per task label
    return counts.select("task_type", "episodes", ratio4(F.col("episodes"), total).alias("share"))


def deepest_pit(episodes: DataFrame) -> DataFrame:
    """The episode with the largest severity x tokens, ties to the earliest; empty when none spiralled."""
    rows = episodes.filter(F.col("severity") > 0)
    best = F.min(F.struct((-(F.col("severity") * F.col("total"))).alias("s"), "file_id", "ep", "session_id", "index", "severity",
                          F.col("total").alias("tokens"), "task_type"))
    return rows.agg(best.alias("b")).filter(F.col("b").isNotNull()).select(
        "b.session_id", "b.index", "b.severity", "b.tokens", "b.task_type")


def effort_calibration(episodes: DataFrame) -> DataFrame:
    """Rates and means by (dial, value, task type); the thinking dial covers one model family and needs a directive."""
    claude = F.startswith(F.coalesce("model", F.lit("")), F.lit("claude"))
    dials = F.array_compact(F.array(
        F.when(F.coalesce("effort", F.lit("")) != "", F.struct(F.lit("effort").alias("dial"), F.col("effort").alias("value"))),
        F.when(F.coalesce("model", F.lit("")) != "", F.struct(F.lit("model").alias("dial"), F.col("model").alias("value"))),
        F.when(claude, F.struct(F.lit("thinking").alias("dial"), F.when(F.col("thinking_directive"), F.lit("on")).otherwise(F.lit("off")).alias("value")))))
    rows = episodes.withColumn("_d", F.explode(dials)).select("*", "_d.dial", "_d.value")
    n = F.count(F.lit(1))
    groups = rows.groupBy("dial", "value", "task_type").agg(
        n.alias("episodes"), ratio4(count_true(F.col("severity") > 0), n).alias("spiral_rate"),
        ratio4(count_true(F.col("end_type") == "corrected"), n).alias("corrected_rate"),
        round_to(ratio(F.sum("duration_seconds"), n), 0).alias("avg_duration_seconds"),
        round_to(ratio(F.sum("total"), n), 0).alias("avg_total_tokens"),
        round_to(ratio(F.sum("reasoning_output"), n), 0).alias("avg_reasoning_tokens"),
        (n < MIN_SAMPLES).alias("low_confidence"))
    seen = episodes.agg(F.coalesce(F.bool_or(claude & F.col("thinking_directive")), F.lit(False)).alias("on")).scalar()
    return groups.filter((F.col("dial") != "thinking") | seen)


def context_rot_buckets(episodes: DataFrame) -> DataFrame:
    """Rates by index range 0-4, 5-9, 10-14, 15-19, 20+; at most five rows."""
    b = F.least(F.floor(F.col("index") / 5), F.lit(4)).cast("bigint")
    spiral, corrected = F.col("severity") > 0, F.col("end_type") == "corrected"
    n = F.count(F.lit(1))
    return episodes.groupBy((b * 5).alias("index_from")).agg(
        n.alias("episodes"), ratio4(count_true(spiral), n).alias("spiral_rate"), ratio4(count_true(corrected), n).alias("corrected_rate"),
        ratio4(count_true(spiral | corrected), n).alias("rot_rate"),
        round_to(ratio(F.sum(F.floor(F.col("error_rate") * 10000 + 0.5)), n * 10000), 4).alias("avg_error_rate"))


def context_rot(episodes: DataFrame) -> DataFrame:
    """Baseline, inflection index and confidence of the curve; one row."""
    enough = F.col("episodes") >= MIN_SAMPLES
    buckets = context_rot_buckets(episodes)
    all_five = Window.partitionBy()  # at most five rows
    head = buckets.select("*", *[c.over(all_five).alias(n) for n, c in {
        "base": F.min_by("rot_rate", F.when(enough, F.col("index_from"))), "base_from": F.min(F.when(enough, F.col("index_from"))),
        "full_buckets": count_true(enough)}.items()])
    jump = F.greatest(F.col("base") * 2, F.col("base") + 0.15)
    later = enough & (F.col("index_from") > F.col("base_from")) & (F.col("rot_rate") >= jump)
    return head.agg(
        F.coalesce(F.max("base"), F.lit(0.0)).alias("baseline_rot_rate"),
        F.min(F.when(later, F.col("index_from"))).alias("inflection_index"),
        (F.coalesce(F.max("full_buckets"), F.lit(0)) < 2).alias("low_confidence"))
