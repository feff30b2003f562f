"""What a search request leaves behind: attempts, totals, failures, usage rows, and the records made of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.documents import count

#: Reasons for which a call was never made.
LOCAL = ("missing_key", "rate_limited", "budget", "cooldown")
TOKENS = ("input_tokens", "output_tokens", "thought_tokens", "total_tokens")


def attempt(operation: Column, provider: Column, status: Column, reason: Column, ms: Column, tokens: Column) -> Column:
    """One attempt; a call that was turned away here counts as none."""
    calls = F.when(F.coalesce(reason, F.lit("")).isin(*LOCAL), 0).otherwise(1)
    return F.struct(operation.alias("operation"), provider.alias("provider"), status.alias("status"), reason.alias("failure_reason"), calls.alias("api_calls"), ms.alias("duration_ms"), tokens.alias("total_tokens"))


def all_attempts(planner: Column, embedding: Column, cache_hit: Column, reranker: Column) -> Column:
    """The attempts of a request in their order: the planner's, one embedding unless the result was cached, the reranker's."""
    return F.concat(planner, F.when(cache_hit, F.slice(F.array(embedding), 1, 0)).otherwise(F.array(embedding)), reranker)


def totals(attempts: Column, fields: Sequence[str]) -> list[Column]:
    """Sums over a record's attempts, with what is below 0 as 0."""
    one = lambda f: F.aggregate(F.transform(attempts, lambda a: count(a[f].cast("string"))), F.lit(0).cast("long"), lambda s, v: s + v)
    return [one(f).alias(f) for f in fields]


def failure_event(request_id: Column, error: Column, ms: Column) -> Column:
    """The record of a failed request: the class of its error and no result, never its message."""
    return F.struct(request_id.alias("request_id"), F.lit("failure").alias("status"), F.regexp_extract(error, r"^([A-Za-z_.]+)", 1).alias("failure_reason"), F.lit(0).alias("total_results"), ms.alias("duration_ms"))


def usage_cube(events: DataFrame, searches: DataFrame) -> DataFrame:
    """Usage by all six keys: each attempt, and one ``search`` row a request, a cache hit or a success."""
    prefix = F.regexp_extract(F.coalesce("provider", F.lit("none")), "^([^:/]*)", 1)
    keys = ["tenant", "month", "operation", "provider", "model", "status"]
    calls = events.select("tenant", "month", "operation", prefix.alias("provider"), "model", "status", "api_calls", "total_tokens")
    own = searches.select("tenant", "month", F.lit("search").alias("operation"), F.lit("engine").alias("provider"), F.lit("").alias("model"), F.when(F.col("cache_hit"), "cache_hit").otherwise("success").alias("status"), F.lit(0).alias("api_calls"), F.lit(0).alias("total_tokens"))
    return calls.unionByName(own).groupBy(*keys).agg(F.count("*").alias("events"), F.sum("api_calls").alias("api_calls"), F.sum("total_tokens").alias("total_tokens"))


def with_applied(categories: Column, applied: Sequence[Column]) -> Column:
    """A record's categories and those that were applied as filters, each once."""
    given = F.filter(F.array(*[F.nullif(F.trim(a), F.lit("")) for a in applied]), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(F.coalesce(categories, F.array().cast("array<string>")), given))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """How many rows have no parent."""
    return children.join(parents.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("orphans"))


def active(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """The rows of each tenant's active version."""
    return rows.join(F.broadcast(manifest.select("tenant", F.col("active").alias("version"))), ["tenant", "version"])


def latest_run(runs: DataFrame) -> DataFrame:
    """Each tenant's newest refresh run."""
    newest = Window.partitionBy("tenant").orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    return runs.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def chart(df: DataFrame, label: str) -> DataFrame:
    """Counts by label, the most frequent first, then by name."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def tail_allowed(enabled: bool, needs_category: bool, filters: Mapping[str, object], category: str = "category") -> bool:
    """Whether a related tail may follow: if enabled, and with an explicit category where one is needed."""
    return enabled and (not needs_category or filters.get(category) not in (None, ""))


def active_names(filters: Mapping[str, object]) -> list[str]:
    """The names of the filters that say something."""
    return [k for k, v in filters.items() if v not in (None, "", [], {})]
