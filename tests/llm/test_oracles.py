"""The corpus queries that SQL can express, against that SQL on the smallest tables."""

import duckdb
import pytest

pytest.importorskip("tesserae.llm")

from tesserae.llm.queries import ORACLES, QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(str(r[names.index(c)]) for c in df.columns) for r in cur.fetchall())
    assert sorted(tuple(str(v) for v in r) for r in df.collect()) == want
