"""Query planning against stated expectations."""

import pytest
from pyspark.sql import functions as F

from tesserae.functions.text import price_bounds
from tesserae.operators import planner

CASES = [
    # query, order, budget, intent, decisive, least, most
    ("cheapest car for rent under 1,500", "price_asc", 1500.0, "offer", True, None, 1500.0),
    ("bikes price high to low", "price_desc", None, "offer", True, None, None),
    ("between rs 900 and 200 camera", None, None, "offer", True, 200.0, 900.0),
    ("wanted tata ace", None, None, "wanted", True, None, None),
    ("wanted to rent a camera", None, None, "offer", False, None, None),
    ("customers looking for cars", None, None, "wanted", True, None, None),
    ("i need a truck above 2000", None, None, "offer", True, 2000.0, None),
    ("owners of cranes", None, None, "offer", False, None, None),
    ("royal enfield 350 cc", None, None, "offer", True, None, None),
    ("tata ace 800", None, 800.0, "offer", True, None, None),
    (None, None, None, "offer", True, None, None),
]


def test_plans(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, q string")
    q = F.col("q")
    intent, decisive = planner.ad_intent(q)
    least, most = price_bounds(q)
    got = df.select("i", planner.sort_order(q), planner.budget(q), intent, decisive, least, most).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [c[1:] for c in CASES]


@pytest.mark.parametrize(("value", "want"), [("  chennai", "Chennai"), ("chenai", "Chennai"), ("xyz", None), ("mumbay", "Mumbai"), ("che", None)])
def test_canonical(value, want):
    assert planner.canonical(value, {"chennai": "Chennai", "mumbai": "Mumbai", "pune": "Pune"}, 0.8) == want


def test_resolve():
    catalogue = {"city": {"chennai": "Chennai"}}
    assert planner.resolve({"city": "CHENNAI", "state": "x"}, catalogue) == ({"city": "Chennai"}, {})
    assert planner.resolve({"city": "nowhere"}, catalogue, {"city": 0.8}) == ({}, {"city": "nowhere"})
