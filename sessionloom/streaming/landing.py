"""Landing of a record stream: what is on time, what is late, and the clock that tells them apart.

The clock of a micro-batch is the largest event time of the batches before it. A record is late when its time is not after the
clock minus the allowed lateness. Late records go to a table of their own, the others to the table that further streams read;
so the rule can be stated, counted and repeated in batch, whatever a later operator keeps in its state. Each batch writes its
own folders once and reads only itself and one clock row.

A landed batch is one step of the further streams: were its files read in several steps, the first ones would move the watermark past
the others. File sources count files, so every on-time batch has the same number of them, however many rows it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.timez import epoch_micros
from ..session import path_exists

#: What a further stream adds to the lateness: event time that one landed batch may span.
SPAN = "1 day"


def drained(query: StreamingQuery) -> list[dict]:
    """Wait for an ``availableNow`` query and give the progress of its batches."""
    query.awaitTermination()
    return [dict(p) if isinstance(p, dict) else p for p in query.recentProgress]


def _micros(ts: Column) -> Column:
    return epoch_micros(ts)


def write_files(rows: DataFrame, folder: str, files: int) -> None:
    """Write ``rows`` as exactly ``files`` files below ``folder``, each by a task of its own.

    Rows that already lie in tasks for all files or all cores stay where they are, others are dealt over the files first. Tasks
    without rows write no file; files of one row of nulls stand for them, which ``on_time`` leaves out. A repeated call only adds
    what is missing.
    """
    spark = rows.sparkSession
    if not path_exists(spark, f"{folder}/_SUCCESS"):
        spread = files == 1 or rows.rdd.getNumPartitions() >= min(files, spark.sparkContext.defaultParallelism)
        (rows.coalesce(files) if spread else rows.repartition(files, *rows.columns)).write.mode("overwrite").parquet(folder)
    missing = files - len(spark.read.schema(rows.schema).parquet(folder).inputFiles())
    if missing > 0:
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
        spark.range(0, missing, 1, missing).select(*nulls).write.mode("append").parquet(folder)


def land(stream: DataFrame, path: str, checkpoint: str, lateness_seconds: int, files: int | None = None) -> list[dict]:
    """Split ``stream (ts, ...)`` into ``path/on_time`` and ``path/late`` by batch; rows without a time are late.

    Each on-time batch is ``files`` files, the number to give to ``on_time``; by default one file for each task that has rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if path_exists(spark, f"{path}/clock/batch={batch_id}/_SUCCESS"):
            return  # a repeated batch that was already complete
        clock = None
        if batch_id:
            clock = spark.read.parquet(f"{path}/clock/batch={batch_id - 1}").first()["clock"]
        held = batch.persist()
        try:
            late = F.col("ts").isNull()
            if clock is not None:
                late = late | (_micros(F.col("ts")) <= clock - lateness_seconds * 1_000_000)
            if not path_exists(spark, f"{path}/late/batch={batch_id}/_SUCCESS"):
                held.filter(late).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
            kept, folder = held.filter(~late), f"{path}/on_time/batch={batch_id}"
            if files:
                write_files(kept, folder, files)
            elif not path_exists(spark, f"{folder}/_SUCCESS"):
                kept.write.mode("overwrite").parquet(folder)
            own = F.max(_micros(F.col("ts")))
            latest = own if clock is None else F.greatest(own, F.lit(clock))
            held.agg(latest.cast("bigint").alias("clock")).write.mode("overwrite").parquet(f"{path}/clock/batch={batch_id}")
        finally:
            held.unpersist()

    return drained(stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start())


def on_time(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Stream of the landed records in order of landing; ``files_per_batch`` as the landing wrote them gives one landed batch a step."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path}/on_time").select(*schema.names).filter(F.col("ts").isNotNull())


def late_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/late").select(*schema.names)
