"""Ordered-set aggregates and evaluation measures over ranked results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a group that are ranked as they are; of larger groups only those around the place are.
RANKED_WHOLE = 1_000_000
#: Error of the sketch that finds the values around a place, and how far around it they lie, as shares of a group.
SKETCH, AROUND = 100_000, 5e-5


#: Parts that the values of each group are dealt to when they meet their group's bounds.
DEALT = 64


def _bounded(rows: DataFrame, keys: list[str], value: str, shares: list[float], also: Sequence[Column], whole: int) -> DataFrame:
    """Distinct values ``_v`` and their counts ``_c``, beside their group's count ``n``, its aggregates ``_also`` and two values around each share, null in small groups."""
    ends = [F.lit(e) for p in shares for e in (max(p - AROUND, 0.0), min(p + AROUND, 1.0))]
    facts = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile_approx(value, F.array(*ends), SKETCH).alias("_b"), F.struct(F.lit(0).alias("_"), *also).alias("_also"))
    at = [F.when(F.col("n") > whole, F.get("_b", F.lit(i))).alias(f"_{'low' if i % 2 == 0 else 'high'}{i // 2}") for i in range(len(ends))]
    counted = rows.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    if not keys:  # one row of facts; a row without a value brings it where there are no others
        none = rows.sparkSession.range(1).select(F.lit(None).cast(rows.schema[value].dataType).alias("_v"), F.lit(0).cast("bigint").alias("_c"))
        return counted.unionByName(none).crossJoin(F.broadcast(facts.select("n", "_also", *at)))
    salted = facts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "n", "_also", *at, F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("_s"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    dealt = counted.withColumn("_r", F.pmod(F.xxhash64("_v"), F.lit(DEALT)).cast("int"))
    return dealt.join(salted, [F.col("_r") == F.col("_s"), *same]).drop("_r", "_s", *[f"_k{i}" for i in range(len(keys))])


def placed(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[float, Column]], also: Sequence[Column] = (), whole: int = RANKED_WHOLE) -> DataFrame:
    """Per group, the values at some places in ascending order (from 1), each computed from the count ``n``.

    ``wanted`` holds, by name, about where a place lies (0 to 1) and the place; ``also`` holds further
    aggregates of the group (named); ``_n`` is the group's count.  Equal values are counted before they move.  A sketch of each group
    gives two values around each place: those between are walked, the rest is only counted by how many
    of them it has passed.  So no task walks a large group, all places come from one pass, and the
    results are exact.  Null values count for nothing, null keys are a group; a group without values has
    null places, and so has an empty table without keys.
    """
    order = sorted(wanted, key=lambda name: wanted[name][0])
    low, high = ([F.col(f"_{end}{i}") for i in range(len(order))] for end in ("low", "high"))
    near = low[0].isNull()
    for a, b in zip(low, high, strict=True):
        near = near | F.col("_v").between(a, b)
    passed = sum((F.when(F.col("_v") >= a, 1).otherwise(0) for a in low), F.lit(0))
    ends = [f"_{end}{i}" for i in range(len(order)) for end in ("low", "high")]
    cells = _bounded(rows, keys, value, [wanted[name][0] for name in order], also, whole).groupBy(*keys, "n", *ends, F.when(near, F.col("_v")).alias("_v"), F.when(~near, passed).alias("_p")).agg(F.sum("_c").alias("_c"), F.first("_also").alias("_also"))
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    found = []
    for i, name in enumerate(order):
        reached = F.col("_v").isNotNull() & (low[i].isNull() | (F.col("_v") >= low[i]))
        under = F.sum(F.when((F.col("_v") < low[i]) | (F.col("_p") <= i), F.col("_c"))).over(group)
        upto = F.coalesce(under, F.lit(0)) + F.sum(F.when(reached, F.col("_c"))).over(group.orderBy("_v"))
        place = wanted[name][1]
        found.append(F.when(reached & (place <= upto) & (place > upto - F.col("_c")), F.col("_v")).alias(name))
    lost = F.raise_error(F.lit("a place lies outside its sketched bounds")).cast(rows.schema[value].dataType)
    one = lambda name: F.when(F.max("n") > 0, F.coalesce(F.max(name), lost)).alias(name)
    out = cells.select(*keys, "n", "_also", *found).groupBy(*keys).agg(*[one(name) for name in order], F.max("n").alias("_n"), F.first("_also").alias("_also"))
    return out.select(*keys, *order, "_n", "_also.*").drop("_")


def picked(rows: DataFrame, keys: list[str], value: str, share: float, place: Column, name: str) -> DataFrame:
    """Per group, the value at one place, as ``placed`` finds it."""
    return placed(rows, keys, value, {name: (share, place)}).drop("_n")


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], also: Sequence[Column] = (), whole: int = RANKED_WHOLE) -> DataFrame:
    """Per group, percentiles by linear interpolation between the two nearest places, beside further aggregates; ``shares`` holds p by name."""
    at = lambda n, name: (F.col(n) - 1) * F.lit(float(shares[name]))
    wanted = {f"{name}_{side}": (shares[name], cut(at("n", name)) + 1) for name in shares for side, cut in (("a", F.floor), ("b", F.ceil))}
    ends = placed(rows.withColumn("_x", F.col(value).cast("double")), keys, "_x", wanted, also, whole)
    kept = [c for c in ends.columns if c not in wanted and c != "_n"]
    between = lambda name: F.col(f"{name}_a") + (F.col(f"{name}_b") - F.col(f"{name}_a")) * (at("_n", name) - F.floor(at("_n", name)))
    return ends.select(*kept, *[between(name).alias(name) for name in shares])


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], also: Sequence[Column] = ()) -> DataFrame:
    """The values at places ceil(p * n), for each p by name, beside further aggregates."""
    return placed(rows, keys, value, {name: (p, F.greatest(F.ceil(F.col("n") * p), F.lit(1))) for name, p in shares.items()}, also).drop("_n")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """The value at place ceil(p * n)."""
    return nearest_ranks(rows, keys, value, {name: p})


def upper_median(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The upper of the two middle values."""
    return picked(rows, keys, value, 0.5, F.floor(F.col("n") / 2) + 1, name)


def rounded_rank(rows: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """The value at place round(p * (n - 1)) from 0, halves to even."""
    return picked(rows, keys, value, p, F.bround((F.col("n") - 1) * p) + 1, name)


def top_shares(rows: DataFrame, key: str, cuts: dict[str, Column], total: str) -> DataFrame:
    """One row: how many rows the keys with most rows hold, ``cuts`` giving how many keys from the count ``n`` of all.

    Keys are counted by their number of rows.  Distinct such numbers sum to at most the rows of the table, so
    there are at most the square root of twice as many, and only these are put in order.  A cut of no
    keys is null.
    """
    held = rows.groupBy(key).agg(F.count("*").alias("_m")).groupBy("_m").agg(F.count("*").alias("_k"))
    down = Window.orderBy(F.desc("_m"))
    known = held.select("_m", "_k", (F.sum("_k").over(down) - F.col("_k")).alias("_before"), F.sum("_k").over(Window.partitionBy()).alias("n"))
    part = lambda cut: F.sum(F.when(cut >= 1, F.col("_m") * F.greatest(F.least(F.col("_k"), cut - F.col("_before")), F.lit(0))))
    return known.agg(*[part(cut).cast("bigint").alias(name) for name, cut in cuts.items()], F.sum(F.col("_m") * F.col("_k")).alias(total))


def measured(results: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 3, depth: int = 10, wanted: DataFrame | None = None) -> DataFrame:
    """Per query: reciprocal rank, precision at k (of those returned), hit within ``depth``, recall of all returned.

    ``results`` holds ``qid, id, rank``; ``relevant`` holds ``qid, id``; a query without results or relevant ids scores 0.
    Where ``relevant`` only holds those among the results, ``wanted`` says how many there are in all: ``qid, wanted``.
    """
    want = relevant.select("qid", "id").distinct()
    got = results.select("qid", "id", "rank").join(want.withColumn("good", F.lit(True)), ["qid", "id"], "left")
    held = want.groupBy("qid").agg(F.count("*").alias("wanted")) if wanted is None else wanted
    return measured_of(got, queries.select("qid").distinct().join(held, "qid", "left"), k, depth)


def measured_of(got: DataFrame, cases: DataFrame, k: int = 3, depth: int = 10) -> DataFrame:
    """``measured`` of hits that are judged, ``qid, id, rank, good``, and of ``cases(qid, wanted)``."""
    good = F.coalesce(F.col("good"), F.lit(False))
    per = got.groupBy("qid").agg(
        F.min(F.when(good, F.col("rank"))).alias("first"),
        F.count(F.when(good & (F.col("rank") <= k), 1)).alias("good_k"),
        F.count(F.when(F.col("rank") <= k, 1)).alias("seen_k"),
        F.max(F.when(good & (F.col("rank") <= depth), 1)).alias("hit"),
        F.countDistinct(F.when(good, F.col("id"))).alias("found"),
    )
    all_ = cases.join(per, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return all_.select(
        "qid",
        zero(1.0 / F.col("first")).alias("reciprocal_rank"),
        zero(F.try_divide("good_k", "seen_k")).alias("precision_at_k"),
        zero(F.col("hit").cast("double")).alias("hit"),
        zero(F.try_divide("found", "wanted")).alias("recall"),
    )


def overlap(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Per query, the share that two rankings' first k have in common, of the shorter one."""
    a, b = (r.where(F.col("rank") <= k).select("qid", "id").distinct() for r in (left, right))
    both = a.withColumn("in_a", F.lit(1)).join(b.withColumn("in_b", F.lit(1)), ["qid", "id"], "full")
    shared = F.count(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), 1))
    return both.groupBy("qid").agg((shared / F.greatest(F.least(F.count("in_a"), F.count("in_b")), F.lit(1))).alias("overlap"))


def overlap_of(both: DataFrame, left: str, right: str, k: int) -> DataFrame:
    """``overlap`` of two rankings that lie beside each other, a row for each query and id; no rank: not in that one."""
    a, b = F.coalesce(F.col(left) <= k, F.lit(False)), F.coalesce(F.col(right) <= k, F.lit(False))
    shared = F.count_if(a & b) / F.greatest(F.least(F.count_if(a), F.count_if(b)), F.lit(1))
    return both.where(a | b).groupBy("qid").agg(shared.alias("overlap"))
