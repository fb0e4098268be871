"""All queries of the library's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.plans import q_events, q_governance, q_intervals, q_metrics, q_retrieval, q_sources, q_training, q_trajectories, q_vectors  # noqa: F401
from quillspan.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 search of every benchmark text over all documents."""
    return QUERIES["r3_bm25_search"](spark, sf_dir)
