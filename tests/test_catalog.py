"""The operators' queries against their own SQL, and what SQL cannot say against plain Python."""

import json
from datetime import date, datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.operators import lifecycle, records, search
from tesserae.plans import catalog, requests, results, spread  # noqa: F401  (the last three add their queries)
from tesserae.sources import bindings, readers
from tesserae.streaming import telemetry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in bindings.RAW:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def _plain(v):
    if v is None or isinstance(v, (str, date)):
        return str(v)
    return f"{float(v):.7g}"


@pytest.mark.parametrize("name", catalog.SQL)
def test_same_as_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    cur = con.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(_plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect()) == want


def test_every_query_is_asked(spark):
    """All ids divisible by 50: of parts for keywords, of embeddings for vectors, of either once fused."""
    data = "/root/testdata/sf0.01"
    ids = {t: {r[0] for r in spark.read.parquet(f"{data}/{t}.parquet").select(c).where(f"{c} % 50 = 0").collect()} for t, c in (("part", "p_partkey"), ("embeddings", "vec_id"))}
    asked = lambda name: {r.qid for r in catalog.QUERIES[name](spark, data).select("qid").distinct().collect()}
    assert asked("r2_keyword_search_whole") == ids["part"]
    assert asked("r7_vector_search_whole") == ids["embeddings"]
    assert asked("r12_fusion_whole") == ids["part"] | ids["embeddings"]


def test_fulfilment_is_of_text_searches(spark):
    """Browse requests ('view' events here) count on their own side only."""
    r = catalog.QUERIES["d1_text_searches"](spark, DATA).first()
    views = spark.read.parquet(f"{DATA}/events.parquet").where("event_type = 'view'").count()
    assert r.browse == views > 0 and r.searches == r.requests - views
    assert r.fulfilment == pytest.approx(100 * r.text_fulfilled / r.searches, abs=1e-5)


def _one(spark, value, make):
    return spark.createDataFrame([(value,)], "q string").select(make(F.col("q")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("make", "query", "want"),
    [
        (text.normalize_query, "  Tata-ACE,  rent!\tChennai ", "tata-ace rent chennai"),
        (text.normalize_query, None, ""),
        (text.brands, "tata ace and an iPhone", ["Tata", "Apple"]),
        (text.brands, "tatami", []),
        (text.locations, "mira   road to chennai", ["Chennai", "Mira Road"]),
        (text.duration, "car per day monthly", "Daily"),
        (text.duration, "car for rent", "Rent (unspecified)"),
        (text.duration, "rental", "Not specified"),
        (text.language, "வண்டி", "Tamil"),
        (text.language, "गाड़ी", "Hindi"),
        (text.is_gibberish, "aaaaaaa car", True),
        (text.is_gibberish, "$$$$$$%%ab", True),
        (text.is_gibberish, "camera", False),
        (text.is_route, "chennai to pune", True),
        (text.operation_group, "Reranking", "reranker"),
        (text.redacted, "Authorization: Bearer abc, api_key='x y'", "Authorization: [REDACTED], api_key=[REDACTED]"),
    ],
)
def test_text(spark, make, query, want):
    assert _one(spark, query, make) == want


def test_attempts_forgive(spark):
    rows = [None, "", "[]", "nonsense", '{"a":1}', '"[{""provider"":""p""}]"', '[{"provider":"p","x":{"y":1}},3,"s",null]']
    df = spark.createDataFrame(list(enumerate(rows)), "i int, raw string").select("i", records.attempts(F.col("raw")).alias("a"))
    assert [len(r.a) for r in df.orderBy("i").collect()] == [0, 0, 0, 0, 0, 1, 1]


def test_verified_bands(spark):
    rows = [(1, "a", 1.0, 1, False), (1, "b", 0.96, 2, True), (1, "c", 0.94, 3, True), (1, "d", 0.9, 4, False), (1, "e", 0.89, 5, True), (2, "f", 0.5, 1, None)]
    df = spark.createDataFrame(rows, "qid int, id string, score double, rank int, verified boolean")
    got = search.verified_first(df, "score", "verified").orderBy("qid", "rank").collect()
    assert [r.id for r in got] == ["b", "a", "c", "d", "e", "f"]


def test_conditions_and_refusals(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, None)], "id int, v string")
    assert [r.id for r in df.where(search.condition({"v": {"$gte": 5}})).collect()] == [1]
    assert df.where(search.condition({"v": {"$in": []}})).count() == 0
    assert [r.id for r in df.where(search.condition({"v": {"$lte_or_null": 9}})).orderBy("id").collect()] == [1, 3]
    for bad in ({"v": {"$like": 1}}, {"v": {"$gt": 1, "$lt": 3}}):
        with pytest.raises(ValueError):
            search.condition(bad)
    with pytest.raises(ValueError):
        lifecycle.without(df, None, "id")
    with pytest.raises(ValueError):
        records.DashboardFilter("7d", since=datetime(2024, 1, 1)).window(datetime(2024, 2, 1))
    assert lifecycle.gate_failures(5, 5, 0.9, 0.9, 0.9) == []
    assert lifecycle.gate_failures(5, 6, 0.3, 0.5, 0.5) == ["row count differs", "recall too low", "recall fell", "keyword results differ"]


def test_snapshot_and_contract(spark, tmp_path):
    root = str(tmp_path / "snap")
    (tmp_path / "t.csv").write_text('id,fee,name\n1,10.5,"a\nb"\n2,oops,\n')
    t = readers.csv_table(spark, str(tmp_path / "t.csv"), {"id": "bigint", "fee": "double", "name": "string"}, defaults={"name": "none"})
    assert [tuple(r) for r in t.orderBy("id").collect()] == [(1, 10.5, "a\nb"), (2, None, "none")]
    with pytest.raises(ValueError, match="missing"):
        readers.conformed(t, {"city": "string"})
    readers.publish(spark, root, {"t": t})
    readers.publish(spark, root, {"t": t.where("id = 1")})
    assert readers.published(spark, root, "t").count() == 1


def test_delivery_and_windows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    source = tmp_path / "in"
    source.mkdir()
    lines = [{"request_id": f"r{i % 6}", "created_at": str(start + timedelta(minutes=i)), "duration_ms": 10.0 * i, "scope": "s"} for i in range(10)]
    (source / "a.json").write_text("\n".join(map(json.dumps, lines)))
    stream = spark.readStream.schema("request_id string, created_at timestamp, duration_ms double, scope string").json(str(source))
    out = str(tmp_path / "out")
    for _ in range(2):
        telemetry.delivered(stream, lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "c1")).awaitTermination(120)
    assert spark.read.parquet(out).count() == 6
    batch = spark.read.schema(stream.schema).json(str(source))
    assert [r.requests for r in telemetry.windowed(batch).orderBy("start").collect()] == [5, 5]
    q = telemetry.limited(stream, 1, 2).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.allowed for r in spark.table("limited").orderBy("created_at").collect()] == [True] * 10
    slow = telemetry.limited(stream.where("minute(created_at) < 9"), 0, 3).writeStream.format("memory").queryName("slow").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    slow.awaitTermination(120)
    assert [r.allowed for r in spark.table("slow").orderBy("created_at").collect()] == [True] * 3 + [False] * 6


def test_listings_hold_what_is_read(spark):
    """Prices and places of listings need no aggregate of their order lines, and are the same without it."""
    plan = catalog.QUERIES["o5_price_resort"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "p_name" in plan
    rows = lambda **kw: sorted(map(str, bindings.run(spark, DATA, results._LISTED, **kw).collect()))
    assert rows() == rows(engagement=False)


def test_tail_with_a_known_number_of_hits(spark):
    """A bound above every query's hits changes no tail."""
    items = results._listings(spark, DATA)
    seen = items.where("deleted_at is null and id % 7 = 0").select((items["id"] % 3).alias("qid"), "id")
    tail = lambda **kw: sorted(map(tuple, results.catalogue.related_tail(seen, items, results.CatalogueFilter(types=["offer"]), 9, **kw).collect()))
    assert tail() == tail(most=5_000) and len(tail()) == 27
