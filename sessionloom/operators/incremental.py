"""A report kept up to date file by file: only changed logs are read again, and the folded result equals a full run.

A run compares the listing of the log folder with the files it knows and reads the changed ones. A message may be repeated in
another file (a resumed session), and keep-first and largest-usage then look across files. So a table of (file, message key)
tells which files share keys, directly or through others; such a family is read together, and no other family can be touched.
Each run writes, for the files it read, compact rows: usage sums by file, quarter of an hour and the dimensions of the report,
counts of results and interruptions, sums of prompt flags, and entry points. A file's newest rows count, older ones are dead.
The folds are the batch operators themselves, which take ``records`` as the weight of a compact row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numbers import ratio, round_to
from ..functions.timez import epoch_micros
from ..schema import TOKEN_BUCKETS
from ..session import path_exists, stage
from ..sources.logs import path_id
from .behavior import prompt_flag_rows
from .filters import main_only
from .usage import usage_rows

FLAGS = ["len", "structured", "file_ref", "constraint", "correction"]
DIMENSIONS = ["platform", "file_id", "session_id", "repo", "branch", "is_sidechain"]
COMPACT = (
    "platform string, file_id string, session_id string, repo string, branch string, is_sidechain boolean, kind string, ts timestamp_ntz, "
    "seq bigint, source string, model string, model_norm string, is_error boolean, records bigint, "
    + ", ".join(f"{c} bigint" for c in [*TOKEN_BUCKETS, "uncached", "fresh", *FLAGS]))


def compact(ev: DataFrame) -> DataFrame:
    """``ev`` as weighted rows: what the folds need, summed by file and quarter of an hour."""
    micros = epoch_micros(F.col("ts"))
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    quarter = F.timestamp_add("MICROSECOND", micros - F.pmod(micros, F.lit(900_000_000)), start).alias("ts")
    n = F.count(F.lit(1)).alias("records")
    usage = usage_rows(ev).withColumn("model", F.col("model_norm")).groupBy(*DIMENSIONS, quarter, "model", "model_norm").agg(
        *[F.sum(c).alias(c) for c in (*TOKEN_BUCKETS, "uncached", "fresh")], n).withColumn("kind", F.lit("tokens"))
    marks = ev.filter(F.col("kind").isin("tool_result", "interrupt", "api_error")).groupBy(*DIMENSIONS, "kind", "is_error", quarter).agg(n)
    entries = ev.groupBy(*DIMENSIONS, "source").agg(F.min("seq").alias("seq"), n).withColumn("kind", F.lit("seen"))
    said = ev.filter(F.col("kind") == "prompt")
    flags = prompt_flag_rows(said.withColumn("ts", quarter), "prompt_text", *DIMENSIONS, "ts").groupBy(*DIMENSIONS, "ts").agg(
        *[F.sum(c).alias(c) for c in FLAGS], n).withColumn("kind", F.lit("prompt"))
    out = usage
    for part in (marks, entries, flags):
        out = out.unionByName(part, allowMissingColumns=True)
    fields = [f.rsplit(" ", 1) for f in COMPACT.split(", ")]
    have = set(out.columns)
    return out.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in fields])


def prompt_signals(rows: DataFrame, *keys: str) -> DataFrame:
    """The prompt measures of compact rows."""
    n = F.sum("records")
    prompts = main_only(rows).filter(F.col("kind") == "prompt")

    def share(c: str) -> Column:
        return round_to(ratio(F.sum(c), n), 4)

    return prompts.groupBy(*keys).agg(
        n.alias("prompts"), round_to(ratio(F.sum("len"), n), 1).alias("avg_len"), share("structured").alias("structured_ratio"),
        share("file_ref").alias("file_ref_ratio"), share("constraint").alias("constraint_ratio"), share("correction").alias("correction_rate"))


@dataclass(frozen=True)
class IncrementalReport:
    """State below ``path``: one folder per run with the files read, their keys, and their compact rows.

    ``read`` turns a list of paths into parsed lines, ``keys`` into (file_id, key) pairs, and ``normalize`` into ``ev``.
    """

    spark: SparkSession
    path: str
    read: Callable[[list[str]], DataFrame]
    keys: Callable[[DataFrame], DataFrame]
    normalize: Callable[[DataFrame], DataFrame]

    def update(self, folder: str, glob: str = "*.jsonl") -> list[str]:
        """Bring the state up to the folder; returns the files that were read."""
        run = self._runs()
        listing = self._listing(folder, glob)
        seen = self._newest("files") if run else None
        changed = listing if seen is None else listing.join(
            seen.select("file_id", F.col("length").alias("_l"), F.col("modified").alias("_m")), "file_id", "left").filter(
            F.col("_l").isNull() | (F.col("_l") != F.col("length")) | (F.col("_m") != F.col("modified"))).select(*listing.columns)
        gone = None if seen is None else seen.join(listing.select("file_id"), "file_id", "left_anti").select("file_id")
        first = stage(changed, "changed-files")
        paths = [r.path for r in first.select("path").collect()]  # the names of what changed since the last run
        lost = gone is not None and not gone.isEmpty()
        if not paths and not lost:
            return []
        touched = first.select("file_id")
        if lost:
            touched = touched.unionByName(gone)
        fresh = stage(self.keys(self.read(paths)).distinct(), "changed-keys") if paths else None
        family = self._family(touched, fresh, run)
        reading = stage(listing.join(family, "file_id", "left_semi"), "family-files")
        paths = sorted(r.path for r in reading.select("path").collect())
        out = f"{self.path}/run={run}"
        if paths:
            good = self.read(paths)
            self.keys(good).distinct().write.mode("overwrite").parquet(f"{out}/keys")
            compact(self.normalize(good)).write.mode("overwrite").parquet(f"{out}/rows")
        else:
            self.spark.createDataFrame([], "file_id string, key string").write.mode("overwrite").parquet(f"{out}/keys")
            self.spark.createDataFrame([], COMPACT).write.mode("overwrite").parquet(f"{out}/rows")
        dead = family.join(listing, "file_id", "left_anti").select("file_id", F.lit(None).cast("string").alias("path"), F.lit(-1).cast("bigint").alias("length"),
                                                                  F.lit(None).cast("timestamp").alias("modified"))
        reading.unionByName(dead).write.mode("overwrite").parquet(f"{out}/files")  # last: a run counts when this folder is complete
        return paths

    def rows(self) -> DataFrame:
        """Compact rows of all files, each from the run that read it last; the folds take them like ``ev``."""
        return self._newest("rows")

    def _listing(self, folder: str, glob: str) -> DataFrame:
        reader = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        return reader.load(folder).select(path_id(F.col("_metadata.file_path")).alias("file_id"), "path", "length", F.col("modificationTime").alias("modified"))

    def _runs(self) -> int:
        run = 0
        while path_exists(self.spark, f"{self.path}/run={run}/files/_SUCCESS"):
            run += 1
        return run

    def _all(self, table: str) -> DataFrame:
        out = None
        for run in range(self._runs()):
            part = self.spark.read.parquet(f"{self.path}/run={run}/{table}").withColumn("_run", F.lit(run))
            out = part if out is None else out.unionByName(part)
        return out

    def _newest(self, table: str) -> DataFrame:
        """Rows of a table from the newest run of each file that still exists."""
        files = self._all("files")
        last = files.groupBy("file_id").agg(F.max_by(F.struct("_run", "length"), "_run").alias("_f")).filter("_f.length >= 0").select(
            "file_id", F.col("_f._run").alias("_run"))
        return self._all(table).join(last, ["file_id", "_run"], "left_semi").drop("_run")

    def _family(self, touched: DataFrame, fresh: DataFrame | None, runs: int) -> DataFrame:
        """All files that share a key with a touched one, directly or through others."""
        known = self._newest("keys") if runs else None
        pairs = fresh if known is None else known if fresh is None else known.unionByName(fresh)
        family = stage(touched.distinct(), "family")
        if pairs is None:
            return family
        pairs = stage(pairs.filter(F.col("key").isNotNull()).distinct(), "file-keys")
        size = family.count()
        while True:
            held = pairs.join(family, "file_id", "left_semi").select("key").distinct()
            family = stage(family.unionByName(pairs.join(held, "key", "left_semi").select("file_id")).distinct(), "family")
            now = family.count()
            if now == size:
                return family
            size = now


def report_of_logs_a(spark: SparkSession, path: str) -> IncrementalReport:
    """The report over platform A logs."""
    from ..sources import logs, normalize_a

    def read(paths: list[str]) -> DataFrame:
        return logs.parse_json(logs.read_log_files(spark, *paths))[0]

    def keys(good: DataFrame) -> DataFrame:
        return normalize_a.project_records(good).filter(F.col("dedup_key").isNotNull()).select("file_id", F.col("dedup_key").alias("key"))

    return IncrementalReport(spark, path, read, keys, normalize_a.normalize_a)
