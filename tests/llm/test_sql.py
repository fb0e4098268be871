"""The queries that have SQL against that SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest
from test_llm_operators import DATA

from quillspan.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    r = con.execute(queries.ORACLE[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert sorted((tuple(x) for x in df.select(*cols).collect()), key=repr) == sorted((tuple(x[i] for i in order) for x in r.fetchall()), key=repr)
