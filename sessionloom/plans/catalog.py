"""All registered queries, and the flagship one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.behavior import dominant_language
from ..operators.topk import top_repos
from ..operators.usage import by_repo
from . import (  # noqa: F401  (they register their queries)
    adoption_queries, behavior_queries, content_queries, episode_queries, log_queries, proposal_queries, reader_queries, scalar_queries, stream_queries,
    usage_queries)
from .adapters import events_as_ev
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events_as_ev(spark, sf_dir)
    return top_repos(by_repo(ev, dominant_language(ev)))
