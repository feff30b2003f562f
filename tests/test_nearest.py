"""Ranking by blocks of scores: against plain Python on odd rows, and what moves."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tesserae.operators import nearest, search
from tesserae.plans import catalog, requests  # noqa: F401  (the second adds its queries)

VECTORS = "id long, vector array<float>"
ASKED = "qid long, query array<float>"


def _cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    norm = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / norm, 9) if norm > 0 else None


def _ranked(pairs, k):
    """(qid, id, score) in rank order, k of each qid."""
    out = []
    for q in sorted({p[0] for p in pairs}):
        out += [(*p, n + 1) for n, p in enumerate(sorted((p for p in pairs if p[0] == q), key=lambda p: (-p[2], p[1]))[:k])]
    return out


def _got(df):
    return [(r.qid, r.id, pytest.approx(r.score, abs=2e-9), r["rank"]) for r in df.orderBy("qid", "rank").collect()]


def test_vectors_of_every_kind(spark, monkeypatch):
    """Ties go by id, copies fill a page, and what has no length, a null or another length has no hits."""
    monkeypatch.setattr(search, "MOST_QUERIES", 3)
    rng = random.Random(1)
    items = [(i, [float(rng.randrange(-4, 5)) for _ in range(4)]) for i in range(300)]
    items += [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(50)] + [(2000, None), (2001, []), (2002, [0.0] * 4), (2003, [1.0, None, 1.0, 1.0]), (2004, [1.0, 2.0]), (2005, [2.0, 1.0])]
    asked = [(q, v) for q, (_, v) in enumerate(items[:7])] + [(50, [1.0, 2.0, 3.0, 4.0]), (51, None), (52, [0.0] * 4), (53, [3.0, 1.0]), (54, [1.0] * 9)]
    want = [(q, i, c) for q, a in asked for i, v in items if (c := _cosine(v, a)) is not None]
    found = search.vector_search(spark.createDataFrame(items, VECTORS).repartition(3), spark.createDataFrame(asked, ASKED), 20)
    assert _ranked(want, 20) == _got(found)
    none = spark.createDataFrame([], VECTORS), spark.createDataFrame([], ASKED)
    assert search.vector_search(none[0], spark.createDataFrame(asked, ASKED), 5).count() == search.vector_search(spark.createDataFrame(items, VECTORS), none[1], 5).count() == 0


def test_words_of_every_kind(spark, monkeypatch):
    """Texts of one id add up, queries of the same words have the same hits, unselected items count for rarity."""
    monkeypatch.setattr(search, "MOST_QUERIES", 2)
    rng = random.Random(2)
    said = ["red", "blue", "ring", "bolt", "x1", "ring ring", ""]
    items = [(i, " ".join(rng.choice(said) for _ in range(rng.randrange(6)))) for i in range(200)] + [(7, "red ring"), (7, "red red"), (9, None)]
    asked = [(1, "Red ring"), (2, "ring, RED ring"), (3, "bolt"), (4, "none"), (5, ""), (6, None), (7, "x1 blue bolt")]
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    mean = sum(len(words(t)) for _, t in items) / len(items)
    want = []
    for q, text in asked:
        score: dict[int, float] = {}
        for t in set(words(text)):
            df = len({i for i, x in items if t in words(x)})
            tf: dict = {}
            for i, x in items:
                if i % 3 and t in words(x):
                    tf[i, len(words(x))] = tf.get((i, len(words(x))), 0) + words(x).count(t)
            for (i, dl), n in tf.items():
                idf = max(math.log((len(items) - df + 0.5) / (df + 0.5)), 1e-6)
                score[i] = score.get(i, 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * dl / mean))
        want += [(q, i, round(s, 9)) for i, s in score.items()]
    df = spark.createDataFrame(items, "id long, text string").repartition(3)
    assert _ranked(want, 9) == _got(search.keyword_search(df, spark.createDataFrame(asked, "qid long, query string"), 9, where=df["id"] % 3 != 0))


def test_best_is_the_same_however_it_comes():
    rng = np.random.default_rng(3)
    scores = np.round(rng.random((4, 5000)), 2)  # many ties
    scores[3, 20:] = nearest.NONE
    scores[2, 17] = np.nan
    ids = rng.permutation(5000)
    for step in (7, 100, 5000):
        best = nearest.Best(4, 25)
        for a in range(0, 5000, step):
            best.add(scores[:, a : a + step], pa.array(ids[a : a + step]))
        got = best.cut().to_pydict()
        for q in range(4):
            hits = sorted((-math.inf if math.isnan(s) else -s, int(i)) for s, i in zip(scores[q], ids, strict=True) if s != nearest.NONE)[:25]
            assert [i for j, i in zip(got["q"], got["id"], strict=True) if j == q] == [i for _, i in hits]


@pytest.mark.parametrize("name", ["r7_vector_search_whole", "r2_keyword_search_whole", "e1_measures", "e3_case_measures"])
def test_no_row_for_every_pair(spark, name):
    """Pairs of query and item are scored in arrays: none is a row of a plan, and a task gives k hits a query."""
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join Cross" not in plan and "Join Inner\n" not in plan


def test_relevant_pairs_are_those_of_hits(spark):
    """Cases are judged without a row for every id of a query's label."""
    found = catalog.QUERIES["r7_vector_search"](spark, "/root/testdata/sf0.01")
    pairs = catalog._hits_labelled(found, catalog._raw(spark, "/root/testdata/sf0.01", "embeddings"))
    assert pairs.count() == found.count()


def test_bands_walk_many_queries_at_once(spark):
    """Pages of all lengths against plain Python, also where batches end within a page; no task runs by query."""
    rng, rows, want = random.Random(4), [], []
    for q in [*range(40), None]:
        scores = sorted((round(rng.uniform(-1, 5), 3) for _ in range(1 + (q or 9) % 13)), reverse=True)
        page = [(q, f"{q}-{i}", s, i + 1, rng.choice([True, False, None])) for i, s in enumerate(scores)]
        rows += page
        anchor, band, placed = None, 0, []
        for r in page:
            if anchor is None or anchor - r[2] > abs(anchor) * 0.05:
                anchor, band = r[2], band + 1
            placed.append((band, not r[4], r[3], r))
        want += [(*r[:3], n + 1, r[4]) for n, (*_, r) in enumerate(sorted(placed, key=lambda p: p[:3]))]
    rng.shuffle(rows)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(size)
    for n in (1, 7, 10_000):
        spark.conf.set(size, n)
        got = search.verified_first(spark.createDataFrame(rows, "qid int, id string, score double, rank int, verified boolean"), "score", "verified")
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
        assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set(size, old)


def test_one_pass_for_statistics(spark):
    """The number of texts, their words and the terms' holders come together, also of texts without words."""
    items = spark.createDataFrame([(1, "red ring red"), (2, None), (3, "ring"), (3, "ring bolt"), (4, "")], "id long, text string")
    base = items.select("id", search.tokens(items["text"]).alias("ts")).selectExpr("id", "ts", "size(ts) as dl")
    terms = spark.createDataFrame([("red",), ("ring",), ("none",)], "term string")
    got = {r.term: r for r in nearest.held_by(base, terms, False).collect()}
    assert (got[""].n, got[""].words) == (5, 6) and {t: r.df for t, r in got.items() if t} == {"red": 1, "ring": 2}


@pytest.mark.parametrize("name", ["i9_overlap", "i9_overlap_whole", "r17_tiers", "r17_tiers_whole"])
def test_each_search_is_asked_once(spark, name):
    """A ranking that is read at several places of a result is made once."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_rankings_beside_each_other(spark):
    """Overlap and tiers of one frame are those of the rankings apart, also where one of them is empty."""
    from tesserae.operators import ranks

    rng = random.Random(5)
    make = lambda qs: spark.createDataFrame([(q, i, n + 1) for q in qs for n, i in enumerate(rng.sample(range(30), 12))], "qid int, id int, rank int")
    a, b = make(range(6)), make(range(3, 9))
    fused, both = search.fuse(a, b), search.fuse(a, b, ranks=True)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(ranks.overlap_of(both, "vr", "rank", 4)) == rows(ranks.overlap(a, fused, 4))
    from pyspark.sql import functions as F

    assert rows(search.tiers_of(both, [F.when(F.col("kr") <= 5, F.col("kr")), F.col("rank"), F.col("vr")])) == rows(search.tiers([b.where("rank <= 5"), fused, a]))


def test_queries_are_read_once(spark, monkeypatch):
    """A block of queries comes in one read that also tells its number; the words' way back to their queries is a second."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    items = spark.createDataFrame([(i, [1.0, float(i)], "red ring" if i % 2 else "bolt") for i in range(9)], "id long, vector array<float>, text string")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.5, 0.1])], ASKED)
    assert search.vector_search(items, vectors.mapInArrow(counted, ASKED), 3).count() == 6 and read.value == 2
    words = spark.createDataFrame([(1, "red"), (2, "bolt bolt")], "qid long, query string")
    assert search.keyword_search(items, words.mapInArrow(counted, "qid long, query string"), 3).count() == 6 and read.value <= 6
    monkeypatch.setattr(search, "MOST_QUERIES", 1)
    assert search.gathered(words) is words
    monkeypatch.setattr(search, "MOST_QUERIES", 2)
    assert sorted(map(tuple, search.gathered(words).collect())) == [(1, "red"), (2, "bolt bolt")]


def test_both_tables_meet_once(spark):
    """What is asked for in both tables is looked up before the searches, not again in each of their plans."""
    for name in ("r20_score_floor", "r12_fusion"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" not in plan


def test_columns_come_along(spark):
    """A hit brings its query's and its item's columns, also nulls, where batches end and vectors differ in length."""
    rng = random.Random(6)
    items = [(i, [float(rng.randrange(1, 9)) for _ in range(2 + i % 2)], None if i % 7 == 0 else f"n{i}") for i in range(60)]
    asked = [(q, v, None if q == 3 else q * 10) for q, (_, v, _) in enumerate(items[:9])]
    found = search.vector_search(spark.createDataFrame(items, VECTORS + ", name string").repartition(3), spark.createDataFrame(asked, ASKED + ", said int"), 5, item_cols=["name"], query_cols=["said"])
    rows = found.collect()
    assert found.columns == ["qid", "said", "id", "name", "score", "rank"] and len(rows) == 45
    assert all(r.said == asked[r.qid][2] and r.name == items[r.id][2] for r in rows)
    assert _ranked([(q, i, c) for q, a, _ in asked for i, v, _ in items if (c := _cosine(v, a)) is not None], 5) == _got(found)


@pytest.mark.parametrize("name", ["e1_measures", "e1_measures_whole", "e3_case_measures", "e4_case_gates"])
def test_hits_are_judged_where_they_lie(spark, name):
    """Labels come with the hits: one search, and no join of the hits with the items."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = plan.count("Join ")
    assert plan.count("MapInArrow") == 1 and joins == (2 if name.startswith("e1") else 1)


def _evaluated(spark, rows, folder, name):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    spark.range(0, 500, 50).selectExpr("id as p_partkey", "'red ring' as p_name").write.mode("overwrite").parquet(f"{folder}/part.parquet")
    return {r.qid: r for r in catalog.QUERIES[name](spark, str(folder)).collect()}


@pytest.mark.parametrize("name", ["e1_measures", "e3_case_measures"])
def test_judged_alike_with_repeated_ids(spark, tmp_path, name):
    """Without repeated ids hits are judged by their own label, with them by all labels of their id: same figures where both hold."""
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], rng.randrange(3)) for i in range(120)]
    alone = _evaluated(spark, rows, tmp_path / "a", name)
    away = [*rows, (901, None, 7), (901, None, 7)]  # an id twice that is in no hit
    assert _evaluated(spark, away, tmp_path / "b", name) == alone and set(alone) == {0, 50, 100}


def test_texts_stay_where_they_lie(spark):
    """What the rules look for is found at the items: no title or text is moved to the hits."""
    from tesserae.plans import results  # noqa: F401  (adds the query)

    plan = catalog.QUERIES["p16_adjusted"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "AS red#" in plan and "AS title#" not in plan


def test_a_page_moves_once(spark):
    """The three windows over a query's rows share one exchange; titles against plain Python, also null, blank and in other cases."""
    rng = random.Random(8)
    rows = [(q, i, i + 1, rng.choice(["Red ring", "red  RING", "bolt", "", " ", None])) for q in range(7) for i in range(q * 3)]
    got = search.diverse(spark.createDataFrame(rows, "qid int, id int, rank int, title string").repartition(3), "title", 4)
    want = []
    for q in range(7):
        seen, first, late = set(), [], []
        for r in (r for r in rows if r[0] == q):
            name = " ".join((r[3] or "").lower().split())
            again = name in seen
            seen |= {name} - {""}
            (late if again or len(first) == 4 else first).append(r)
        want += [(q, r[1], n + 1) for n, r in enumerate(first + late)]
    assert sorted(map(tuple, got.select("qid", "id", "rank").collect())) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1


def test_blocks_are_brought_in_one_read(spark, monkeypatch):
    """More queries than a block are read once, and rows of a query stay in one block; beyond ``MOST_READ`` a read each block finds the same."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rng = random.Random(9)
    items = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(40)]
    asked = [(None if q == 8 else q % 6, v) for q, (_, v) in enumerate(items[:9])]  # some ids twice, one null
    make = lambda: spark.createDataFrame(asked, ASKED).mapInArrow(counted, ASKED)
    found = lambda: sorted(map(str, search.vector_search(spark.createDataFrame(items, VECTORS), make(), 4).collect()))
    whole = found()
    assert len(whole) == 28 and read.value == 9
    monkeypatch.setattr(search, "MOST_QUERIES", 2)
    assert found() == whole and read.value == 18
    monkeypatch.setattr(search, "MOST_READ", 3)
    assert found() == whole and read.value > 27


@pytest.mark.parametrize("name", ["e1_measures_whole", "e3_case_measures", "e4_case_gates"])
def test_judged_queries_are_read_once(spark, tmp_path, monkeypatch, name):
    """Embeddings are opened once for queries and items, also where queries are several blocks; the figures stay."""
    rng, opened, raw = random.Random(10), [], catalog._raw
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], rng.randrange(3)) for i in range(400)]
    want = _evaluated(spark, rows, tmp_path, name)
    monkeypatch.setattr(search, "MOST_QUERIES", 3)
    monkeypatch.setattr(catalog, "_raw", lambda *a: opened.append(a[2]) or raw(*a))
    asked = spark.sparkContext.accumulator(0)
    vectors = catalog._vectors

    def counted(batches):
        for batch in batches:
            asked.add(batch.num_rows)
            yield batch

    def watched(*a):
        v = vectors(*a)
        return v.mapInArrow(counted, v.schema)

    monkeypatch.setattr(catalog, "_vectors", watched)
    got = _evaluated(spark, rows, tmp_path, name)
    assert got == want and len(got) == 8 and asked.value == 8
    assert opened.count("embeddings") == (2 if name.startswith("e1") else 1)
