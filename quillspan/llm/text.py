"""Shared native expressions on texts. A word is a run of ``[^\\x20\\x09-\\x0D]``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Array of the words of a text, in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.size(words(text)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Slices of ``rows`` rows: what a task takes apart into Python objects at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def spread(counted: DataFrame, n: str = "n", nth: str = "nth", per: int = 1000) -> DataFrame:
    """One row for each of the ``n`` equal rows that a row of ``counted`` stands for, numbered from 0 by ``nth``.

    Counts over ``per`` leave the task that counted them in parts of ``per`` rows, so that no task writes out a hot row alone."""
    parts = lambda df: df.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / per).cast("long"))))
    hot = parts(counted.filter(F.col(n) > per))
    dealt = parts(counted.filter(F.col(n) <= per)).unionByName(hot.repartition(F.xxhash64(*[F.col(f"`{c}`") for c in hot.columns])))
    last = F.least(F.col(n), (F.col("__part") + 1) * per) - 1
    return dealt.withColumn(nth, F.explode(F.sequence(F.col("__part") * per, last))).drop(n, "__part")
