"""The corpus pipeline: documents in, packed batches out.

Five stages, each a function of (spark, docs, sf_dir) to a DataFrame. Every stage works on all that its predecessor
kept; between stages the rows are written as Parquet and read again, by ``run`` to the shared scratch folder.

1. quality classifier: documents that it rejects go (the labels table of the dataset teaches it);
2. line dedup: lines on ten sites or more stay in their first document only; documents that lose all their words go;
3. MinHash near-dedup: one document of each group stays (five-word shingles, similarity 0.8);
4. mixing: documents are dropped, kept or doubled so that each source meets its token target. The second copy of a document has the
   same doc_id; rows of a repeated doc_id take the copies of their row;
5. packing: length buckets and token-budget batches; one row a piece of a copy.

All stages but the last return the columns of ``documents``; ``n_chars`` follows the text. Nulls, empty and very long
texts, ties, repeated rows and empty tables are handled as the operators state; extra columns pass through all stages but the
last, whatever their names (names that begin with ``__`` are reserved).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import line_dedup, mixing, near_dup, packing, quality_model
from quillspan.plans.scratch import materialize
from quillspan.plans.tables import table


def _apart(docs: DataFrame, step: Callable[[DataFrame], DataFrame], *own: str) -> DataFrame:
    """``step`` of ``docs`` with the columns of ``docs``; those named like a column that the step adds are put aside meanwhile."""
    aside = {c: f"__aside_{c}" for c in docs.columns if c in own}
    out = step(docs.withColumnsRenamed(aside))
    return out.select([F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def step(d: DataFrame) -> DataFrame:
        return quality_model.classify(d, table(spark, sf_dir, "labels")).filter("predicted = 1")

    return _apart(docs, step, "held_out", "score", "predicted")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def step(d: DataFrame) -> DataFrame:
        out = line_dedup.dedup_lines(d, drop_emptied=True)
        return out.withColumn("n_chars", F.length("text").cast(d.schema["n_chars"].dataType)) if "n_chars" in d.columns else out

    return _apart(docs, step, "n_lines", "n_removed")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs).select(docs.columns)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("mixing", mixture),
    ("packing", batches),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: A learned classifier and hashed rounding have no SQL form; the stages are tested one by one instead.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
