"""Queries of the record sources and sinks: tables written by Spark to the scratch folder and read by the typed readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspan.plans.registry import ORACLE, QUERIES, plain, query
from quillspan.plans.scratch import dealt, scratch_root
from quillspan.plans.tables import table
from quillspan.sources import records as S


def _folder(spark, label: str) -> str:
    return f"{scratch_root(spark)}/quillspan/{label}-{uuid.uuid4().hex}"


def s1(spark, sf_dir):
    """Conversations as JSON lines of a declared schema."""
    path = _folder(spark, "jsonl")
    table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").write.json(path)
    return S.read_records(spark, path, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


def s2(spark, sf_dir):
    """One folder a conversation, one record a file; stems that occur twice are rejected."""
    path = _folder(spark, "one-per-file")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    # a file a row: tasks move their own files to the folder when they are done, or else the driver moves them one by one
    dealt(c).write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).json(path)
    good, twice = S.read_one_per_file(spark, path, "conv_id long, turns long")
    return good.select("conv_id", "turns").unionByName(twice.select(F.col("n").alias("conv_id"), F.lit(-1).cast("long").alias("turns")))


def s3(spark, sf_dir):
    """S3: labels as a CSV of an exact header."""
    path = _folder(spark, "csv")
    table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").write.option("header", True).csv(path)
    return S.read_ratings(spark, path, "doc_id long, quality int, toxic int")


def s4(spark, sf_dir):
    """Inputs and labels in separate roots, a folder a subsplit, joined again."""
    path = _folder(spark, "split")
    rows = table(spark, sf_dir, "labels").withColumns({"subsplit": F.concat(F.lit("s"), F.col("doc_id") % 3), "x": F.md5(F.col("doc_id").cast("string"))})
    S.write_split(rows, path, ["x"], ["quality", "toxic"], "doc_id", "subsplit")
    a = S.read_records(spark, f"{path}/public", "doc_id long, x string, subsplit string")
    b = S.read_records(spark, f"{path}/private", "doc_id long, quality int, toxic int")
    return a.join(b.drop("subsplit"), "doc_id").select("doc_id", "subsplit", "x", "quality", "toxic")


QUERIES |= {"s1_json_lines": s1, "s2_one_per_file": s2, "s3_ratings_csv": s3, "s4_split_sink": s4}
ORACLE |= {
    "s1_json_lines": "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations",
    "s2_one_per_file": "SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id",
    "s3_ratings_csv": "SELECT doc_id, quality, toxic FROM labels",
    "s4_split_sink": "SELECT doc_id, 's' || CAST(doc_id % 3 AS VARCHAR) AS subsplit, md5(CAST(doc_id AS VARCHAR)) AS x, quality, toxic FROM labels",
}

TURNS = "SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM {conversations}"


@query("s4_chat_rows", f"SELECT conv_id, turn, length(text) + length(reply) AS n FROM ({plain(TURNS)}) WHERE reply IS NOT NULL")
def s4_chat(get):
    rows = get(TURNS).filter("reply IS NOT NULL")
    j = rows.withColumn("m", F.from_json(S.chat_row(F.col("text"), F.col("reply")), "messages array<struct<role:string,content:string>>")["messages"])
    return j.select("conv_id", "turn", (F.length(F.get("m", F.lit(0))["content"]) + F.length(F.get("m", F.lit(1))["content"])).cast("long").alias("n"))
