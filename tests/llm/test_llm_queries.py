"""Every query of the subpackage on the smallest tables, against its SQL where it has one."""

import glob
import os

import duckdb
import pytest

from galley.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, data, name):
    df = Q.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(cols).collect()), key=repr)
    assert got
    if name in Q.ORACLE:
        con = duckdb.connect()
        for f in glob.glob(f"{data}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
        res = con.execute(Q.ORACLE[name])
        names = [c[0] for c in res.description]
        assert got == sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=repr)
