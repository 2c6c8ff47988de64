"""A keyed table that a stream corrects: the largest usage of each key, also when it comes late.

A batch writes the maxima of its own keys and reads nothing else. Every ``every`` batches they are merged into the base, which is
bucketed by key, so the merge shuffles only what the batches brought. A base is complete before the record that names it
is written: readers take the newest record, so they switch from one whole version to the next. The version before stays for readers
that began with it; older ones and the merged batches are deleted. So a reader's files are bounded by buckets and ``every``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..schema import TOKEN_BUCKETS
from ..session import path_exists, remove_path
from .landing import drained

ORDER = ("file_id", "seq")


@dataclass(frozen=True)
class Version:
    number: int
    batch: int  # the last batch merged into it
    buckets: int


@dataclass(frozen=True)
class MaxUsageTable:
    """The table below ``path``; ``buckets`` counts for versions still to be written."""

    spark: SparkSession
    path: str
    key: str = "dedup_key"
    buckets: int = 8
    every: int = 8

    def run(self, stream: DataFrame, checkpoint: str) -> list[dict]:
        """Merge everything that is available."""
        return drained(stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(self.merge).start())

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Add one batch; repeating it changes nothing."""
        done = self.version()
        if done and batch_id <= done.batch:
            return
        best = Window.partitionBy(self.key).orderBy(F.desc("total"), *ORDER)
        rows = batch.filter(F.col(self.key).isNotNull() & F.col("total").isNotNull()).select(self.key, *ORDER, *TOKEN_BUCKETS)
        top = rows.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
        top.write.mode("overwrite").parquet(self._delta(batch_id))
        if (batch_id + 1) % self.every == 0:
            self.compact(batch_id)

    def compact(self, batch_id: int) -> None:
        """Write the base up to ``batch_id`` and switch to it."""
        old = self.version()
        new = Version(old.number + 1 if old else 0, batch_id, self.buckets)
        name, path = self._table(new.number), self._base(new.number)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_path(self.spark, path)  # left by an attempt that never became a version
        rows = self._merged(old, batch_id).repartition(new.buckets, self.key)
        rows.write.format("parquet").option("path", path).bucketBy(new.buckets, self.key).saveAsTable(name)
        record = self.spark.createDataFrame([(new.number, new.batch, new.buckets)], "number int, batch bigint, buckets int")
        record.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/version={new.number}")
        if old:
            for n in range(old.number):
                for gone in (f"{self.path}/versions/version={n}", self._base(n)):
                    remove_path(self.spark, gone)
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table(n)}")
            first = max(0, old.batch - 2 * self.every + 1)
            for n in range(first, old.batch + 1):  # the batches since then serve readers of the version before
                remove_path(self.spark, self._delta(n))

    def version(self) -> Version | None:
        if not path_exists(self.spark, f"{self.path}/versions"):
            return None
        rows = self.spark.read.parquet(f"{self.path}/versions").select("number", "batch", "buckets").collect()  # two rows at most
        return Version(*max(rows)) if rows else None

    def current(self) -> DataFrame:
        """Key and token buckets of the largest usage seen so far."""
        return self._merged(self.version(), None).select(self.key, *TOKEN_BUCKETS)

    def _merged(self, base: Version | None, upto: int | None) -> DataFrame:
        first = base.batch + 1 if base else 0
        paths, n = [], first
        while (upto is None or n <= upto) and path_exists(self.spark, f"{self._delta(n)}/_SUCCESS"):
            paths.append(self._delta(n))
            n += 1
        fields = [self.key, *ORDER, *TOKEN_BUCKETS]
        new = None
        if paths:
            rows = self.spark.read.parquet(*paths)
            new = rows.groupBy(self.key).agg(F.min(self._rank(rows)).alias("_new")).withColumnRenamed(self.key, "_k")
        if base is None:
            if new is None:
                raise ValueError(f"no batch was merged into {self.path}")
            return new.select(F.col("_k").alias(self.key), *self._fields("_new"))
        old = self._read(base)
        if new is None:
            return old.select(*fields)
        old = old.select(self.key, self._rank(old).alias("_old"))
        both = old.join(new, old[self.key] == new["_k"], "full_outer")
        return both.select(F.coalesce(self.key, "_k").alias(self.key), F.least("_old", "_new").alias("_best")).select(self.key, *self._fields("_best"))

    def _rank(self, rows: DataFrame) -> Column:
        """Largest total first, then the earliest record; the other buckets follow along."""
        rest = [c for c in TOKEN_BUCKETS if c != "total"]
        return F.struct((-rows["total"]).alias("_t"), *[rows[c] for c in ORDER], *[rows[c] for c in rest])

    def _fields(self, struct: str) -> list[Column]:
        named = [F.col(f"{struct}.{c}").alias(c) for c in (*ORDER, *TOKEN_BUCKETS) if c != "total"]
        return [*named, (-F.col(f"{struct}._t")).alias("total")]

    def _read(self, version: Version) -> DataFrame:
        name = self._table(version.number)
        if not self.spark.catalog.tableExists(name):  # a new session: name the files' buckets again
            schema = self.spark.read.parquet(self._base(version.number)).schema
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            self.spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (`{self.key}`) INTO {version.buckets} BUCKETS "
                           f"LOCATION '{self._base(version.number)}'")
        return self.spark.table(name)

    def _table(self, number: int) -> str:
        place = "".join(c if c.isalnum() else "_" for c in self.path.rsplit("/", 1)[-1])
        return f"max_usage_{place}_{number}"

    def _base(self, number: int) -> str:
        return f"{self.path}/base-{number}"

    def _delta(self, batch_id: int) -> str:
        return f"{self.path}/delta-{batch_id}"
