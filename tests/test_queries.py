"""Every registered query against its SQL on the smallest tables; the entry module with and without the optional part."""

from __future__ import annotations

import glob
import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from quillspan import queries

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def norm(v):
    if v is None or isinstance(v, str | bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, int):
        return v
    v = float(v)
    return None if math.isnan(v) else float(f"{v:.9g}")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    if name not in queries.ORACLE:
        assert got
        return
    r = duck.execute(queries.ORACLE[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted((tuple(norm(x[i]) for i in order) for x in r.fetchall()), key=repr)


def test_flagship(spark):
    assert queries.flagship(spark, DATA).count() > 0


def test_entry_without_the_optional_part(tmp_path):
    """The rest imports, lists and runs its queries where exactly the two optional folders are deleted."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    here = tmp_path / "repo"
    shutil.rmtree(here / "quillspan" / "llm", ignore_errors=True)
    shutil.rmtree(here / "tests" / "llm", ignore_errors=True)
    code = """
import __spark_entry__ as m
q = m.queries()
assert len(q) > 100 and not any(k.startswith("op") or k == "pipeline" for k in q) and set(m.oracle_sql()) <= set(q)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert q["s5_manifest"](spark, "%s").count() > 0
""" % DATA
    path = os.pathsep.join([str(here), *filter(None, [os.environ.get("PYTHONPATH")])])
    env = os.environ | {"PYTHONPATH": path, "PYTHONDONTWRITEBYTECODE": "1"}
    subprocess.run([sys.executable, "-c", code], cwd=here, check=True, env=env)
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=here, capture_output=True, text=True, env=env)
    assert found.returncode == 0 and "test_operators.py" in found.stdout, found.stdout
