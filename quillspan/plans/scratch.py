"""Tables between the jobs of one operator, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a folder of our own on a local master (tests);
    a cluster has no folder that driver and executors are sure to share, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-")
    return f"file://{_own[app]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost
    executors, and gives later joins true sizes, so that Spark itself decides what is small enough to broadcast."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/quillspan/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` in four even parts a core, for steps that cost far more than reading: Spark cuts files by their bytes, so a million narrow rows may be one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` gave and that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_scratch_path", None):
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
