"""Reading append-only JSON-lines logs: files, line numbers, tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

RAW_SCHEMA = "file_id string, line_no bigint, value string"


def _read(spark: SparkSession, paths: str | list[str], glob: str | None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return with_line_no(reader.text(paths))


def read_logs_a(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All ``*.jsonl`` files below a folder as (file_id, line_no, value)."""
    return _read(spark, path, "*.jsonl")


def read_logs_b(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All ``rollout-*.jsonl`` files below a folder, or explicitly named files."""
    return _read(spark, path, "rollout-*.jsonl")


def read_log_files(spark: SparkSession, *files: str) -> DataFrame:
    """Exactly the named files, whatever their names."""
    return with_line_no(spark.read.text(list(files)))


def path_id(path: Column) -> Column:
    """A file's path as its id: percent codes are read, plus signs stay."""
    return F.url_decode(F.regexp_replace(path, r"\+", "%2B"))


def with_line_no(raw: DataFrame) -> DataFrame:
    """Number the lines of each file from 0.

    A file is read in blocks, each by one task in order, so the row id counts up inside a block. One small table
    with the first id and size of every block gives the offsets; large files stay split over tasks.
    """
    rows = raw.select(
        "value", path_id(F.col("_metadata.file_path")).alias("file_id"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    before = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(F.col("file_id").alias("_f"), F.col("_block").alias("_b")).agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).select(
        "_f", "_b", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    joined = rows.join(blocks, (F.col("file_id") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return joined.select("file_id", (F.col("_id") - F.col("_first") + F.col("_offset")).alias("line_no"), "value")


def parse_json(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): parsed records with a ``rec`` variant, and the non-blank lines that are no JSON object."""
    # The one-element explode keeps later filters above the parse step; they would otherwise be rewritten on the
    # raw text and parse every line again for each field they test.
    raw.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # the last value of a repeated key counts
    lines = raw.filter(F.rlike("value", F.lit(r"\S"))).withColumn("rec", F.explode(F.array(F.try_parse_json("value"))))
    # A line that parses is an object if it starts with a brace; the type of the parsed record would be put together from all its fields.
    is_object = F.rlike("value", F.lit(r"^\s*\{")) & F.col("rec").isNotNull()
    return lines.filter(is_object).drop("value"), lines.filter(~is_object).select("file_id", "line_no", "value")


def get(v: Column, path: str, dtype: str = "string") -> Column:
    """Typed field of a variant; null when missing or of another shape."""
    return F.try_variant_get(v, path, dtype)


def kind_of(v: Column) -> Column:
    """Type name of a variant value: STRING, BIGINT, BOOLEAN, OBJECT<...>, ARRAY<...>; null when missing."""
    return F.schema_of_variant(v)


def text_at(v: Column, path: str) -> Column:
    """Field as text only when the log holds a string there."""
    return F.when(kind_of(get(v, path, "variant")) == "STRING", get(v, path, "string"))


def flag_at(v: Column, path: str) -> Column:
    """True only for a JSON true."""
    node = get(v, path, "variant")
    return F.coalesce((kind_of(node) == "BOOLEAN") & get(v, path, "boolean"), F.lit(False))


def number_at(v: Column, path: str) -> Column:
    """Whole number at a path, 0 when missing or not a number."""
    node = kind_of(get(v, path, "variant"))
    is_number = node.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(node, F.lit("DECIMAL"))
    return F.coalesce(F.when(is_number, get(v, path, "double").cast("bigint")), F.lit(0).cast("bigint"))


def has_shape(v: Column, path: str, shape: str) -> Column:
    """Whether the node at a path is an OBJECT or an ARRAY."""
    return F.coalesce(F.startswith(kind_of(get(v, path, "variant")), F.lit(shape)), F.lit(False))


def prompt_history(good: DataFrame) -> DataFrame:
    """P7: (file_id, seq, session_id, ts, text) of a prompt history, one ``{session_id, ts, text}`` record a line, ts in seconds."""
    r = F.col("rec")
    seconds = F.when(kind_of(get(r, "$.ts", "variant")).isin("BIGINT", "DOUBLE"), get(r, "$.ts", "double"))
    return good.select(
        "file_id", F.col("line_no").alias("seq"), F.coalesce(text_at(r, "$.session_id"), F.lit("")).alias("session_id"),
        F.timestamp_micros((seconds * 1000000).cast("bigint")).cast("timestamp_ntz").alias("ts"), text_at(r, "$.text").alias("text")).filter(F.col("text").isNotNull())
