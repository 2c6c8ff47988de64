"""Connected components of a table of links, by smallest labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stage


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(id, label)`` for every id that has a link: the smallest id reachable.

    Each round gives an id the smallest label around it and then follows labels one step, so rounds grow with the logarithm
    of a component's width. Rounds are written tables: an executor's loss costs one round at most.
    """
    edges = links.select(F.col(a).alias("id"), F.col(b).alias("other"))
    edges = stage(edges.union(edges.select("other", "id")).where("id != other").distinct(), "edges")
    labels = stage(edges.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("label")), "labels")
    while True:
        around = edges.join(labels.select(F.col("id").alias("other"), "label"), "other").groupBy("id").agg(F.min("label").alias("near"))
        near = labels.join(around, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        step = stage(near.join(jump, "label").select("id", "old", F.least("label", "further").alias("label")), "labels")
        labels = step.select("id", "label")
        if step.where("old != label").isEmpty():
            return labels
