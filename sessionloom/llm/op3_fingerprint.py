"""Document fingerprints: the ``SIZE`` smallest hashes of a text's word 5-shingles.

The sketch of a union is the smallest hashes of both sketches, so fingerprints merge across parts. Among the smallest hashes
of the union, the part that both sketches hold estimates resemblance; the largest kept hash estimates how many distinct
shingles there are; both together estimate containment. Sketches of fewer hashes than ``SIZE`` are exact.

Everything is built-in column functions. Defined cases: null texts are empty; a text of fewer than five words is one shingle,
one without words has none; two empty sketches are alike (1), an empty and another one are not (0). Repeated rows get equal
fingerprints. In the order of documents null ids come first and equal ids follow by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import table

WORDS = 5
SIZE = 128
#: Documents of a piece of the id order, on average.
PIECE = 1024


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sorted smallest shingle hashes of column ``text``."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+"), lambda w: w != "")
    hashed = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    h, n = F.col("_h"), F.size("_h")
    shingles = F.when(n >= WORDS, F.transform(
        F.sequence(F.lit(0), F.greatest(n - WORDS, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)])))
    shingles = shingles.when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    return hashed.withColumn(name, F.slice(F.sort_array(F.array_distinct(shingles)), 1, SIZE)).drop("_h")


def merged(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, SIZE)


def resemblance(a: Column, b: Column) -> Column:
    """Estimated shared part of all shingles of two texts, 0 to 1."""
    union = merged(a, b)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union))


def distinct_shingles(sketch: Column) -> Column:
    """Estimated number of distinct shingles."""
    top = (F.element_at(sketch, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < SIZE, F.size(sketch).cast("double")).otherwise((SIZE - 1) / top)


def containment(a: Column, b: Column) -> Column:
    """Estimated part of the first text's shingles that the second holds, 0 to 1."""
    r = resemblance(a, b)
    shared = r / (1 + r) * (distinct_shingles(a) + distinct_shingles(b))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a)))


def as_text(sketch: Column) -> Column:
    """A sketch as hexadecimal digits, 16 for each hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``next_<column>`` of the row with the next ``doc_id``; the first row follows the last. Columns hold no nulls.

    The id order is cut into pieces of about ``PIECE`` rows, each sorted by itself. A table of one row for each piece
    leads to the next piece, and only the last row of a piece is joined to it. All branches read one shuffle.
    """
    span = df.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).first()
    low, n = float(span.low or 0), span.n
    width = max(1.0, (float(span.high or 0) - low + 1) / max(1.0, n / PIECE))
    piece = F.coalesce(F.floor((F.col("doc_id").cast("double") - F.lit(low)) / F.lit(width)).cast("long"), F.lit(-1).cast("long"))
    order = Window.partitionBy("_piece").orderBy(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    rows = df.withColumn("_piece", piece)
    rows = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns], F.lag(columns[0]).over(order).alias("_before"))
    heads = rows.where("_before is null").select(F.col("_piece").alias("_to"), *[F.col(c).alias(f"_{c}") for c in columns])
    pieces = df.select(piece.alias("_piece"), F.floor(piece / PIECE).alias("_group")).distinct()
    inner = Window.partitionBy("_group").orderBy("_piece")
    links = pieces.withColumn("_to", F.lead("_piece").over(inner))
    groups = pieces.groupBy("_group").agg(F.min("_piece").alias("_start"))
    every = Window.orderBy("_group")  # one row for a million documents
    after = groups.select("_group", F.coalesce(
        F.lead("_start").over(every), F.first("_start").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_after"))
    links = links.join(after, "_group").select("_piece", F.coalesce("_to", "_after").alias("_to"))
    last = F.col(f"next_{columns[0]}").isNull()
    ends = rows.where(last).drop(*[f"next_{c}" for c in columns]).join(links, "_piece").join(heads, "_to")
    ends = ends.withColumnsRenamed({f"_{c}": f"next_{c}" for c in columns})
    kept = [*df.columns, *[f"next_{c}" for c in columns]]
    return rows.where(~last).select(*kept).unionByName(ends.select(*kept))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_sketch(docs, "text", "sketch"), ["text", "sketch"])
    n, m = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", F.concat(
        F.substring("text", F.lit(1), n - m), F.substring("next_text", F.lit(1), m)).alias("edited"))
    done = with_sketch(edited, "edited", "edited_sketch")
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return done.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(a).alias("fingerprint"),
        as_text(b).alias("edited_fingerprint"), resemblance(a, b).alias("near_edited"), resemblance(a, c).alias("near_next"),
        distinct_shingles(a).alias("shingles_estimate"), containment(a, b).alias("contained_in_edited"))


QUERIES = {"op3_fingerprints": op3_fingerprints}
SQL: dict[str, str] = {}
