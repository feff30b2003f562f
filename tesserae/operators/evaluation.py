"""Evaluating search: gates of cases, measures of suites, labelled cases, and summaries of load tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators import ranks


def case_measures(ranked: DataFrame, relevant: DataFrame, forbidden: DataFrame, cases: DataFrame) -> DataFrame:
    """``qid, first, hit_10, found, forbidden_10`` of each case: the first relevant rank, whether one is among
    ten, how many of all hits are relevant, and how many of the first ten are forbidden."""
    hits = ranked.join(relevant.select("qid", "id", F.lit(True).alias("good")), ["qid", "id"], "left").join(forbidden.select("qid", "id", F.lit(True).alias("bad")), ["qid", "id"], "left")
    return measures_of(hits, cases)


def measures_of(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """``case_measures`` of hits that are judged: ``qid, rank, good, bad``."""
    each = hits.groupBy("qid").agg(F.min(F.when(F.col("good"), F.col("rank"))).alias("first"), F.count_if(F.col("good")).alias("found"), F.count_if(F.col("bad") & (F.col("rank") <= 10)).alias("forbidden_10"), F.count("*").alias("returned"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return cases.select("qid").join(each, "qid", "left").select("qid", "first", F.coalesce(F.col("first") <= 10, F.lit(False)).alias("hit_10"), zero("found"), zero("forbidden_10"), zero("returned"))


def failures(gates: Sequence[tuple[str, Column]]) -> Column:
    """The names of the gates that do not hold, in order; a gate that cannot be judged fails."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates]), lambda x: x.isNotNull())


def suite(measures: DataFrame, run: str = "run") -> DataFrame:
    """The mean reciprocal rank of each run, and the median over runs beside it."""
    by_run = measures.groupBy(run).agg(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))
    return by_run.join(by_run.agg(F.median("mrr").alias("median_mrr")), F.lit(True))  # a suite has few runs


def load_summary(calls: DataFrame, seconds: float) -> DataFrame:
    """One row: calls a second, mean and percentiles of their times, and how many failed."""
    places = {f"p{p}": (p / 100, F.bround((F.col("n") - 1) * (p / 100)) + 1) for p in (50, 95, 99)}
    also = [F.count("*").alias("calls"), F.avg("ms").alias("mean_ms"), F.count_if(F.col("status") != "success").alias("failed")]
    return ranks.placed(calls, [], "ms", places, also).withColumn("rps", F.col("calls") / seconds).drop("_n")


def final_ids(primary: DataFrame, continuation: DataFrame, k: int) -> DataFrame:
    """The ids of a run: the primary page's, then the continuation's, each once, k at most: ``qid, id, rank``."""
    from tesserae.operators.search import tiers

    return tiers([primary, continuation]).where(F.col("rank") <= k).select("qid", "id", "rank")
