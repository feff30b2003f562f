"""Metrics over places of values, over the keys with most rows and over names in texts, with their plain SQL.

The SQL is the exact statement; the queries come to the same values without a group, a ranking or a pair of
tables in one task.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.operators import ranks, search
from tesserae.plans.catalog import _NQ, _canonical, _query

_HALF, _MOST = {"median_ms": 0.5, "p95_ms": 0.95}, {"p99_ms": 0.99}


def _four(*names: str) -> list:
    return [F.round(n, 4).alias(n) for n in names]


@_query("select round(avg(duration_ms), 4) as avg_ms, round({pct}(duration_ms, 0.5), 4) as median_ms, round({pct}(duration_ms, 0.95), 4) as p95_ms, round({pct}(duration_ms, 0.99), 4) as p99_ms, round(min(duration_ms), 4) as min_ms, round(max(duration_ms), 4) as max_ms, round(stddev_samp(duration_ms), 4) as std_ms from tapi")
def q23_latency_stats(spark, sf_dir):
    t = _canonical(spark, sf_dir, "tapi").select("duration_ms")
    also = [F.avg("duration_ms").alias("avg_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"), F.stddev_samp("duration_ms").alias("std_ms")]
    return ranks.percentiles(t, [], "duration_ms", _HALF | _MOST, also).select(*_four("avg_ms", "median_ms", "p95_ms", "p99_ms", "min_ms", "max_ms", "std_ms"))


@_query("select execution_path as label, round(avg(duration_ms), 4) as avg_ms, round({pct}(duration_ms, 0.5), 4) as median_ms, round({pct}(duration_ms, 0.95), 4) as p95_ms, cast(count(*) as bigint) as n from tapi group by execution_path")
def q24_latency_by_path(spark, sf_dir):
    t = _canonical(spark, sf_dir, "tapi").select(F.col("execution_path").alias("label"), "duration_ms")
    also = [F.avg("duration_ms").alias("avg_ms"), F.count("*").alias("n")]
    return ranks.percentiles(t, ["label"], "duration_ms", _HALF, also).select("label", *_four("avg_ms", "median_ms", "p95_ms"), "n")


@_query("select round(avg(rental_fee), 4) as avg_fee, round({pct}(rental_fee, 0.5), 4) as median_fee from ads where rental_fee > 0")
def q60_rental_fee_stats(spark, sf_dir):
    ads = _canonical(spark, sf_dir, "ads").where("rental_fee > 0").select("rental_fee")
    return ranks.percentiles(ads, [], "rental_fee", {"median_fee": 0.5}, [F.avg("rental_fee").alias("avg_fee")]).select(*_four("avg_fee", "median_fee"))


@_query("select round(avg(contact_views), 6) as avg_views, {pct}(contact_views, 0.5) as median_views, cast(max(contact_views) as bigint) as most, cast(sum(contact_views) as bigint) as total, cast(count(*) as bigint) as ads from ads where contact_views > 0")
def q69_contact_views(spark, sf_dir):
    ads = _canonical(spark, sf_dir, "ads").where("contact_views > 0").select("contact_views")
    also = [F.round(F.avg("contact_views"), 6).alias("avg_views"), F.max("contact_views").alias("most"), F.sum("contact_views").alias("total"), F.count("*").alias("ads")]
    return ranks.percentiles(ads, [], "contact_views", {"median_views": 0.5}, also)


@_query("select round(avg(length(coalesce(description, ''))), 6) as avg_len, {pct}(length(coalesce(description, '')), 0.5) as median_len, cast(max(length(coalesce(description, ''))) as bigint) as max_len, cast(count(case when coalesce(description, '') = '' then 1 end) as bigint) as empty from ads")
def q71_description_length(spark, sf_dir):
    ads = _canonical(spark, sf_dir, "ads").select(F.length(F.coalesce("description", F.lit(""))).alias("len"))
    also = [F.round(F.avg("len"), 6).alias("avg_len"), F.max("len").cast("bigint").alias("max_len"), F.count_if(F.col("len") == 0).alias("empty")]
    return ranks.percentiles(ads, [], "len", {"median_len": 0.5}, also)


@_query("select cat_name as label, round(avg(rental_fee), 4) as avg_fee, round({pct}(rental_fee, 0.5), 4) as median_fee, round(min(rental_fee), 4) as min_fee, round(max(rental_fee), 4) as max_fee from named where rental_fee > 0 and rental_fee < 1000000 group by cat_name")
def q78_pricing_benchmark(spark, sf_dir):
    fees = _canonical(spark, sf_dir, "named").where("rental_fee > 0 and rental_fee < 1000000").select(F.col("cat_name").alias("label"), "rental_fee")
    also = [F.avg("rental_fee").alias("avg_fee"), F.min("rental_fee").alias("min_fee"), F.max("rental_fee").alias("max_fee")]
    return ranks.percentiles(fees, ["label"], "rental_fee", {"median_fee": 0.5}, also).select("label", *_four("avg_fee", "median_fee", "min_fee", "max_fee"))


@_query("select cast(sum(case when r <= greatest(1, floor(n * 0.01)) then ads end) as bigint) as top1, cast(sum(case when r <= floor(n * 0.1) then ads end) as bigint) as top10, cast(sum(ads) as bigint) as total from (select count(*) as ads, row_number() over (order by count(*) desc, user_id) as r, count(*) over () as n from ads group by user_id) x")
def q84_seller_concentration(spark, sf_dir):
    cuts = {"top1": F.greatest(F.lit(1), F.floor(F.col("n") * 0.01)), "top10": F.floor(F.col("n") * 0.1)}
    return ranks.top_shares(_canonical(spark, sf_dir, "ads").select("user_id"), "user_id", cuts, "total")


def _cities_sql(source: str, k: int) -> str:
    return f"select n.n_name as label, count(*) as n from {source} t join nation n on contains(' ' || {_NQ.format('t.query_text')} || ' ', ' ' || lower(n.n_name) || ' ') group by n.n_name order by n desc, label limit {k}"


def _cities(searches, spark, sf_dir, k: int):
    names = _canonical(spark, sf_dir, "location").select(F.col("city").alias("label"), text.normalize_query(F.col("city")).alias("name"))
    found = search.naming(searches.withColumn("words", text.normalize_query(F.col("query_text"))), "words", names, "name")
    return found.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(k)


@_query(_cities_sql("txt", 20))
def q5_location_mentions(spark, sf_dir):
    return _cities(_canonical(spark, sf_dir, "txt"), spark, sf_dir, 20)


@_query(_cities_sql("(select h.* from txt h join ok a on a.request_id = h.request_id where a.total_results = 0)", 15))
def q85_zero_results_cities(spark, sf_dir):
    empty = _canonical(spark, sf_dir, "ok").where("total_results = 0").select("request_id")
    return _cities(_canonical(spark, sf_dir, "txt").join(empty, "request_id"), spark, sf_dir, 15)
