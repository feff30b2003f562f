"""Search records: telemetry joined to searches, parsed attempts, outcomes, dashboard filters and pages."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import like_escaped, normalize_query

SUCCESS = ("success", "successful", "ok")
#: Attempt fields that a record may carry.
ATTEMPT = (
    "array<struct<attempt_number:int,provider:string,model:string,operation:string,status:string,api_calls:int,"
    "input_tokens:int,output_tokens:int,thought_tokens:int,total_tokens:int,duration_ms:double,failure_reason:string>>"
)
PERIODS = {"24h": timedelta(hours=24), "7d": timedelta(days=7), "30d": timedelta(days=30), "90d": timedelta(days=90)}


def succeeded(status: Column) -> Column:
    return F.lower(F.coalesce(status, F.lit(""))).isin(*SUCCESS)


def rate(part: Column, whole: Column) -> Column:
    """A percentage; 0 of nothing is 0."""
    return F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0))


def attempts(raw: Column) -> Column:
    """The attempts in a JSON text; doubled quotes are forgiven, entries that are no objects dropped, all else is no attempt."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    mended = F.regexp_replace(F.replace(text, F.lit('""'), F.lit('"')), r'^"(.*)"$', "$1")

    def read(t: Column) -> Column:
        listed = F.when(F.startswith(t, F.lit("[")), F.from_json(t, "array<string>"))
        objects = F.filter(listed, lambda x: F.startswith(x, F.lit("{")))
        return F.from_json(F.concat(F.lit("["), F.array_join(objects, ","), F.lit("]")), ATTEMPT)

    return F.coalesce(read(text), read(mended), F.from_json(F.lit("[]"), ATTEMPT))


def latest_usage(searches: DataFrame, usage: DataFrame) -> DataFrame:
    """Searches with the latest usage row of their request; clashing usage columns get ``_api``."""
    w = Window.partitionBy("request_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())
    last = usage.where("request_id is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    for c in last.columns:
        if c != "request_id" and c in searches.columns:
            last = last.withColumnRenamed(c, c + "_api")
    return searches.join(last, "request_id", "left")


def outcome(status: Column, total_results: Column) -> Column:
    """A successful search without a result count has zero results."""
    s = F.coalesce(F.lower(status), F.lit("missing"))
    return F.when(s == "missing", "telemetry_missing").when(~s.isin(*SUCCESS), "failure").when(F.coalesce(total_results, F.lit(0)) == 0, "zero_result").otherwise("fulfilled")


def request_kind(query: Column, filters: list[Column], ad_type: Column) -> Column:
    any_filter = F.coalesce(*[F.nullif(f.cast("string"), F.lit("")) for f in filters]).isNotNull() if filters else F.lit(False)
    other = F.lower(F.coalesce(F.nullif(ad_type, F.lit("")), F.lit("offer"))) != "offer"
    return F.when(normalize_query(query) != "", "text_search").when(any_filter | other, "filtered_browse").otherwise("catalogue_browse")


@dataclass(frozen=True)
class DashboardFilter:
    """What a dashboard shows: a period or bounds, and values that a record must have."""

    period: str = "all"
    since: datetime | None = None
    until: datetime | None = None
    outcome: str | None = None
    category: str | None = None
    city: str | None = None
    execution_path: str | None = None
    provider: str | None = None
    operation: str | None = None

    def window(self, as_of: datetime) -> tuple[datetime | None, datetime | None]:
        """Both ends count.  A fixed period ends at ``as_of``."""
        if self.period not in {*PERIODS, "all", "custom"}:
            raise ValueError(f"unknown period {self.period!r}")
        if self.period != "custom" and (self.since or self.until):
            raise ValueError("bounds need the custom period")
        if self.since and self.until and self.since > self.until:
            raise ValueError("the period ends before it starts")
        return (as_of - PERIODS[self.period], as_of) if self.period in PERIODS else (self.since, self.until)


def shown(records: DataFrame, wanted: DashboardFilter, as_of: datetime) -> DataFrame:
    """The records a dashboard shows; undated ones only where time has no bound.

    Provider and operation must be those of one and the same attempt.  Text compares without case.
    """
    since, until = wanted.window(as_of)
    same = lambda c, v: F.lower(F.coalesce(c, F.lit(""))) == v.lower()
    out = records
    if since:
        out = out.where(F.col("created_at") >= F.lit(since))
    if until:
        out = out.where(F.col("created_at") <= F.lit(until))
    for name in ("outcome", "city", "execution_path"):
        if getattr(wanted, name):
            out = out.where(same(F.col(name), getattr(wanted, name)))
    if wanted.category:
        out = out.where(F.exists("categories", lambda c: same(c, wanted.category)))
    if wanted.provider or wanted.operation:
        fits = lambda a: (same(a["provider"], wanted.provider) if wanted.provider else F.lit(True)) & (same(a["operation"], wanted.operation) if wanted.operation else F.lit(True))
        out = out.where(F.exists("attempts", fits))
    return out


def explored(records: DataFrame, term: str = "", cursor: tuple[datetime, str] | None = None, size: int = 50) -> DataFrame:
    """A page of the query explorer, newest first; browsing shows only where it failed; the cursor is the last row seen."""
    out = records.where((F.col("request_kind") == "text_search") | (F.col("outcome") == "failure"))
    if term:
        out = out.where(F.lower("query_text").like("%" + like_escaped(term.lower()) + "%"))
    if cursor:
        out = out.where((F.col("created_at") < F.lit(cursor[0])) | ((F.col("created_at") == F.lit(cursor[0])) & (F.col("request_id") < cursor[1])))
    return out.orderBy(F.col("created_at").desc(), F.col("request_id").desc()).limit(size)


def public(records: DataFrame, names: dict[str, str]) -> DataFrame:
    """The listed fields under their public names; fields that the records lack are left out."""
    return records.select(*[F.col(c).alias(name) for c, name in names.items() if c in records.columns])


def log_window(lines: DataFrame, least: int, after: int | None, k: int) -> DataFrame:
    """Log lines of at least a severity, with their place: the first k after an id, or the last k where none is given."""
    kept = lines.where(F.col("severity") >= least)
    page = kept.where(F.col("seen") > after).orderBy("seen").limit(k) if after is not None else kept.orderBy(F.desc("seen")).limit(k)
    return page.select("request_id", "seen", F.row_number().over(Window.orderBy("seen")).alias("r"))
