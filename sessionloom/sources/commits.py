"""Commit log lines: TAB-separated hash, ISO time, subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.timez import parse_instant


def parse_commits(raw: DataFrame, *keep: str) -> DataFrame:
    """hash (8 characters), commit_ts and subject; lines without hash and time are dropped, tabs in subjects stay."""
    parts = F.split(F.regexp_replace("value", r"\r\z", ""), "\t", 3)
    part = lambda i: F.get(parts, F.lit(i))
    return raw.filter((part(0) != "") & (part(1) != "")).select(
        *keep, F.substring(part(0), 1, 8).alias("hash"), parse_instant(part(1)).alias("commit_ts"), F.coalesce(part(2), F.lit("")).alias("subject"))


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    return parse_commits(spark.read.text(path))
