"""Canonical analytics tables bound to the star-schema files, as common table expressions.

The same relational text runs on Spark and on the checking engine; the few functions that differ in
name are written as ``{pct}``-style marks and filled in by ``dialect``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

CTES: dict[str, str] = {
    "categories": "select id, p_type as name, id % 2 + 1 as cat_group from (select p_type, cast(dense_rank() over (order by p_type) as bigint) as id from (select distinct p_type from part) x) y",
    "sub_categories": "select p.p_partkey as id, c.id as categoryid, p.p_name as name from part p join categories c on c.name = p.p_type",
    "states": "select cast(r_regionkey as bigint) as id, r_name as name from region",
    "location": "select cast(n_nationkey as bigint) as id, n_name as city, cast(n_regionkey as bigint) as state_id, cast(50 + 2 * n_nationkey as double) as price from nation",
    "users": "select c.c_custkey as id, cast(n.n_regionkey as bigint) as state_id, cast(c.c_nationkey as bigint) as city_id, c.c_custkey % 3 as gender, c.c_custkey % 4 as platform, case when c.c_acctbal > 5000 then 1 else 0 end as is_verified, (select min(o_orderdate) from orders) + (c.c_custkey % 400) * INTERVAL '1' DAY as created_at from customer c join nation n on n.n_nationkey = c.c_nationkey",
    "eng": "select l_orderkey as ads_id, sum(l_quantity) as views, count(*) as favs, count(case when l_returnflag = 'A' then 1 end) as likes from lineitem group by l_orderkey",
    "ads": "select o.o_orderkey as id, o.o_custkey as user_id, p.p_partkey as category_id, cast(c.c_nationkey as bigint) as city_id, p.p_name as title, p.p_brand || ' ' || p.p_type as description, o.o_totalprice / 100 as rental_fee, o.o_orderkey % 2 as is_rent_negotiable, o.o_orderstatus as status, o.o_orderdate as created_at, case when o.o_orderstatus = 'F' then o.o_orderdate end as deleted_at, case when o.o_orderpriority = '1-URGENT' then o.o_orderdate end as premium_start_date, case when o.o_orderpriority = '2-HIGH' then o.o_orderdate end as top_start_date, case when o.o_orderkey % 3 > 0 then 'p' end as photos, case when o.o_orderkey % 5 > 0 then 'k' end as keywords, o.o_orderkey % 11 as contact_views, coalesce(e.views, 0) as actual_view_count, coalesce(e.favs, 0) as total_favorite, coalesce(e.likes, 0) as total_like from orders o join customer c on c.c_custkey = o.o_custkey join part p on p.p_partkey = o.o_orderkey % (select count(*) from part) left join eng e on e.ads_id = o.o_orderkey",
    "ads_attributes": "select l_orderkey as ads_id, cast(l_linenumber as bigint) as attribute_id, cast(l_partkey as {string}) as value from lineitem",
    "attributes": "select distinct cast(l_linenumber as bigint) as id, 'attribute ' || cast(l_linenumber as {string}) as name from lineitem",
    "attribute_values": "select p_partkey as id, p_brand as value from part",
    "search_history": "select e.event_id as id, cast(e.event_id as {string}) as request_id, case when e.event_type = 'view' then '' else p.p_name || ' rent in ' || n.n_name end as query_text, e.ts as created_at from events e join part p on p.p_partkey = e.event_id % (select count(*) from part) join nation n on n.n_nationkey = e.event_id % 25",
    "api_usage": "select event_id as id, cast(event_id as {string}) as request_id, case event_type when 'click' then 'semantic' when 'purchase' then 'direct_semantic' else 'deterministic_filter' end as execution_path, k % 25 as total_results, case when event_type = 'error' then 'failure' else 'success' end as status, value * 10 as duration_ms, k * 10 as total_tokens, k * 6 as input_tokens, k * 4 as output_tokens, 1 + event_id % 4 as api_call_count, ts as created_at from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events) e",
    "attempts": "select u.request_id, u.duration_ms, 'p' || cast(u.id % 3 as {string}) as provider, 'm' || cast(u.id % 2 as {string}) as model, case when u.id % 2 = 0 then 'reranking' else 'query_planning' end as operation, case when u.id % 7 = 0 then 'fallback' when u.id % 11 = 0 then 'failed' else 'success' end as status, u.total_tokens, case when u.id % 11 = 0 then 'timeout' end as failure_reason from api_usage u",
    "txt": "select * from search_history where trim(coalesce(query_text, '')) <> ''",
    "tapi": "select a.* from api_usage a where a.request_id in (select request_id from txt)",
    "ok": "select * from tapi where lower(coalesce(status, '')) in ('success', 'successful', 'ok')",
    "named": "select a.*, s.name as sub_name, c.name as cat_name, c.cat_group, l.city, l.state_id, t.name as state_name from ads a left join sub_categories s on s.id = a.category_id left join categories c on c.id = s.categoryid left join location l on l.id = a.city_id left join states t on t.id = l.state_id",
}

_SPARK = {"string": "string", "pct": "percentile", "month": "date_format({x}, 'yyyy-MM')"}
_DUCK = {"string": "varchar", "pct": "quantile_cont", "month": "strftime({x}, '%Y-%m')"}


def dialect(sql: str, spark: bool) -> str:
    """A query over canonical tables as one statement with its common table expressions."""
    return _marked(_with(CTES, sql), _SPARK if spark else _DUCK)


def _with(tables: dict[str, str], sql: str) -> str:
    return "with " + ",\n".join(f"{k} as ({v})" for k, v in tables.items()) + "\n" + sql


def _marked(body: str, words: dict[str, str]) -> str:
    for mark in ("string", "pct"):
        body = body.replace("{" + mark + "}", words[mark])
    while "{month:" in body:
        a = body.index("{month:")
        b = body.index("}", a)
        body = body[:a] + words["month"].replace("{x}", body[a + 7 : b]) + body[b + 1 :]
    return body


def _named_in(sql: str, tables: dict[str, str]) -> dict[str, str]:
    """The tables that a query names, and those that these name, in the given order."""
    found, texts = set(), [sql]
    while texts:
        words = set(re.findall(r"\w+", texts.pop()))
        new = [t for t in tables if t in words and t not in found]
        found.update(new)
        texts += [tables[t] for t in new]
    return {t: v for t, v in tables.items() if t in found}


#: Of listings, what comes from a left join to one row each at most: without it the rows are the same.
_ENGAGEMENT = (
    ", coalesce(e.views, 0) as actual_view_count, coalesce(e.favs, 0) as total_favorite, coalesce(e.likes, 0) as total_like",
    " left join eng e on e.ads_id = o.o_orderkey",
)


def run(spark: SparkSession, sf_dir: str, sql: str, engagement: bool = True) -> DataFrame:
    """The query as a lazy DataFrame: scans are pruned and filters pushed down by the optimiser.

    Only the tables that it names are bound, within the statement: the session's views stay as they are.
    A query that reads no ``engagement`` of listings can say so; a name of it is an error then.
    """
    files = {t: "select * from parquet.`" + f"{sf_dir}/{t}.parquet".replace("`", "``") + "`" for t in RAW}
    tables = CTES if engagement else CTES | {"ads": CTES["ads"].replace(_ENGAGEMENT[0], "").replace(_ENGAGEMENT[1], "")}
    needed = _named_in(sql, tables)
    sources = {t: v for t, v in files.items() if t in set(re.findall(r"\w+", " ".join([sql, *needed.values()])))}
    return spark.sql(_marked(_with(sources | needed, sql) if sources else sql, _SPARK))
