"""Access to the tables of one dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``<sf_dir>/<name>.parquet``, read by Spark (any store that Spark can reach)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
