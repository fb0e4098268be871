"""Typed record sources and sinks (S1-S6). All reading and writing is Spark's, so any store works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.plans.scratch import materialize

IDENTIFIER = "^[A-Za-z0-9][A-Za-z0-9_.:-]*$"


def read_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines of a declared schema; a malformed row fails the read when it is run."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_one_per_file(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """One JSON record a file, keyed by the file's stem: (records with ``stem``, stems that occur twice). Each file is opened once, when this is called:
    a file costs far more than its record, so the records are kept as a table."""
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(path)
    rows = materialize(raw.select("*", F.regexp_extract(F.col("_metadata.file_name"), "^(.*?)(\\.[^.]*)?$", 1).alias("stem")), "records")
    twice = rows.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(twice.select("stem"), "stem", "left_anti"), twice


def read_ratings(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """S3: a ratings CSV whose header must be the schema's columns in order."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def write_split(rows: DataFrame, root: str, public: list[str], private: list[str], key: str, subsplit: str) -> None:
    """Inputs and labels to separate roots, one folder a subsplit."""
    rows.select(key, subsplit, *public).write.partitionBy(subsplit).json(f"{root}/public")
    rows.select(key, subsplit, *private).write.partitionBy(subsplit).json(f"{root}/private")


def chat_row(prompt: Column, target: Column, system: Column | None = None) -> Column:
    """A chat record as JSON: messages of system (if any), user and assistant."""
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.array(*([say("system", system)] if system is not None else []), say("user", prompt), say("assistant", target))
    return F.to_json(F.struct(messages.alias("messages")), {"ignoreNullFields": "false"})


def row_digest(*columns: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def manifest(rows: DataFrame, columns: list[str], group: str, by: list[str] | None = None) -> DataFrame:
    """Counts, distinct groups, and a digest of the content that does not depend on row order.

    The digest is over the count of rows, the exact sum of the first 15 hex digits of their digests, and the least and the greatest of
    these: it is computed by partial aggregation, no row list is gathered anywhere."""
    d = rows.withColumn("__d", row_digest(*columns))
    number = F.conv(F.substring("__d", 1, 15), 16, 10).cast("decimal(38,0)")
    agg = d.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(F.col(group)).alias("n_groups"),
        F.sum(number).cast("string").alias("__s"),
        F.min("__d").alias("__lo"),
        F.max("__d").alias("__hi"),
    )
    return agg.withColumn("digest", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), "__s", "__lo", "__hi"), 256)).drop("__s", "__lo", "__hi")


def media_manifest(sources: DataFrame, least: int = 15, most: int = 30) -> tuple[DataFrame, DataFrame]:
    """(source_id, license, clips array<struct<clip_id, start_ms, end_ms>>) -> clip rows, and the broken rules.

    Rules: an interval is not empty and does not start below 0, clip ids are unique, the whole manifest has ``least`` to ``most`` clips."""
    clips = sources.select("source_id", "license", F.inline("clips"))
    bad = clips.filter(~((F.col("start_ms") >= 0) & (F.col("start_ms") < F.col("end_ms")))).select(F.col("clip_id").alias("key"), F.lit("interval").alias("rule"))
    twice = clips.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("clip_id").alias("key"), F.lit("duplicate_clip").alias("rule"))
    licence = sources.filter(F.trim(F.coalesce("license", F.lit(""))) == "").select(F.col("source_id").alias("key"), F.lit("license").alias("rule"))
    total = clips.agg(F.count(F.lit(1)).alias("n")).filter(~F.col("n").between(least, most)).select(F.lit("manifest").alias("key"), F.lit("clip_count").alias("rule"))
    return clips, bad.unionByName(twice).unionByName(licence).unionByName(total)


def bad_identifiers(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose identifier is null or not of the allowed form."""
    return rows.filter(F.col(column).isNull() | ~F.col(column).rlike(IDENTIFIER))
