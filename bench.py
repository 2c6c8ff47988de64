"""Headline queries at one scale factor: one warm-up, then the median of three runs, as one JSON line.

The event table is landed once before the timed runs, and counts in the total as ``land_ev``; every run then reads the
landed Parquet table. ``episode_detail`` and ``normalize_a`` rebuild their written stages in every run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from sessionloom.operators import episodes
from sessionloom.plans import catalog, log_queries
from sessionloom.plans.adapters import events_as_ev
from sessionloom.plans.episode_queries import CAP
from sessionloom.plans.registry import plain
from sessionloom.sources import logs, normalize_a

HEADLINE = [
    "a1_token_totals", "a2_estimate_cost", "a4_by_repo", "a7_models_timeline", "a12_top_commands", "a13_git_habits", "a16_error_signals",
    "a24_project_buckets", "a25_file_churn", "a28_session_candidates", "d5_digest_stats", "h8_prompt_flags", "j2_max_usage", "j10_commits_in_session",
    "w1_token_deltas", "w2_active_seconds", "t6_top_sessions", "a36_hygiene_stats", "w11_type_p90", "w17_effort_calibration", "p2_own_baselines",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(build) -> float:
    start = time.perf_counter()
    run(build())
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        # the given tables are single small files: small row groups and splits let the stages made from them use all cores
        .config("spark.hadoop.parquet.block.size", str(4 << 20)).config("spark.sql.files.openCostInBytes", str(256 << 10))
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    events_as_ev(spark, sf_dir)
    landing = time.perf_counter() - start
    seconds = {"land_ev": round(landing, 3)}
    jobs = {name: (lambda n=name: catalog.QUERIES[n](spark, sf_dir)) for name in HEADLINE}
    jobs["episode_detail"] = lambda: plain(episodes.episode_detail(events_as_ev(spark, sf_dir), CAP))
    jobs["normalize_a"] = lambda: plain(normalize_a.normalize_a(logs.parse_json(log_queries.raw_lines_a(spark, sf_dir))[0]))
    for name, job in jobs.items():
        timed(job)
        seconds[name] = round(statistics.median(timed(job) for _ in range(3)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)}))
    spark.stop()


if __name__ == "__main__":
    main()
