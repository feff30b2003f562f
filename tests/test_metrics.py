"""Every metric against the checking engine on the smallest tables."""

import math

import duckdb
import pytest

from tesserae.plans.metrics import METRICS
from tesserae.sources import bindings

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in bindings.RAW:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def _plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return f"{v:.4f}"
    try:
        return f"{float(v):.4f}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", METRICS)
def test_same_as_oracle(spark, con, name):
    df = bindings.run(spark, DATA, METRICS[name])
    cols = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(bindings.dialect(METRICS[name], False))
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(_plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want
    assert not math.isnan(len(want))
