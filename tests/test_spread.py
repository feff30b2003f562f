"""Places of values and the largest keys: exact where the sketch narrows them down, with ties, nulls and no rows."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tesserae.operators import ranks, search

SHARES = {"p01": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [("a", rng.gauss(0, 50)) for _ in range(30_000)] + [("b", float(rng.randrange(4))) for _ in range(30_000)]
    out += [(None, rng.random()) for _ in range(2_000)] + [("c", None)] * 5 + [("d", 1.5)] + [("a", None)] * 50
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("whole", [10, 1_000_000])
@pytest.mark.parametrize("keys", [["k"], []])
def test_percentiles_are_exact(spark, rows, whole, keys, monkeypatch):
    monkeypatch.setattr(ranks, "AROUND", 1e-3)  # the sketch's error is in whole rows, of which these groups have few
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r["k"] if keys else 0): [r[n] for n in SHARES] for r in ranks.percentiles(df, keys, "v", SHARES, whole=whole).collect()}
    by = {}
    for k, v in rows:
        by.setdefault(k if keys else 0, []).append(v)
    con = duckdb.connect()
    assert got.keys() == by.keys()
    for k, vs in by.items():
        con.execute("create or replace table t (v double)")
        con.execute("insert into t select unnest($1::double[])", [vs])
        want = con.execute("select " + ", ".join(f"quantile_cont(v, {p})" for p in SHARES.values()) + " from t").fetchone()
        assert got[k] == [pytest.approx(x, rel=1e-12) if x is not None else None for x in want]


def test_places_of_no_rows(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert ranks.percentiles(none, ["k"], "v", {"m": 0.5}).collect() == []
    assert [(r.m, r.c) for r in ranks.percentiles(none, [], "v", {"m": 0.5}, [F.count("*").alias("c")]).collect()] == [(None, 0)]
    cuts = {"one": F.greatest(F.lit(1), F.floor(F.col("n") * 0.1))}
    assert [(r.one, r.total) for r in ranks.top_shares(none.select("k"), "k", cuts, "total").collect()] == [(None, None)]


def test_top_shares(spark):
    rng = random.Random(3)
    held = {i: rng.choice([1, 1, 1, 2, 3, 9, 40]) for i in range(95)} | {None: 7}
    df = spark.createDataFrame([(k,) for k, m in held.items() for _ in range(m)], "k int")
    cuts = {"tenth": F.floor(F.col("n") * 0.1), "third": F.floor(F.col("n") * 0.33), "none": F.floor(F.col("n") * 0.001)}
    r = ranks.top_shares(df, "k", cuts, "total").first()
    down = sorted(held.values(), reverse=True)
    assert (r.tenth, r.third, r.none, r.total) == (sum(down[:9]), sum(down[:31]), None, sum(down))


def test_naming(spark):
    texts = [(1, "red ring in new york"), (2, "york york"), (3, ""), (4, None), (5, "newyork ring")]
    names = spark.createDataFrame([("new york",), ("york",), ("ring",), ("",), ("a b c d e f",)], "name string")
    got = search.naming(spark.createDataFrame(texts, "id int, t string"), "t", names, "name")
    assert sorted((r.id, r.name) for r in got.collect()) == [(1, "new york"), (1, "ring"), (1, "york"), (2, "york"), (5, "ring")]
