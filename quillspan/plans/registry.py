"""Registry of queries: each runs an operator over the tables of a dataset and may name equivalent SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.plans.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tables_of(sql: str) -> set[str]:
    return {f for _, f, _, _ in string.Formatter().parse(sql) if f}


def adapt(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a portable SQL text whose tables stand in braces, over one dataset folder."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in tables_of(sql)})


def plain(sql: str) -> str:
    """The same text for an engine in which the tables are views."""
    return sql.format_map({n: n for n in tables_of(sql)})


def query(name: str, oracle: str | None = None):
    """Register ``f(get)``, where ``get(sql)`` gives a DataFrame of a portable SQL text."""

    def put(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(lambda sql: adapt(spark, sf_dir, sql))
        if oracle is not None:
            ORACLE[name] = plain(oracle)
        return f

    return put
