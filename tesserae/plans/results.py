"""Queries of the catalogue side of search over the star-schema files, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions.text import tokens
from tesserae.operators import catalogue, search
from tesserae.operators.catalogue import CatalogueFilter
from tesserae.plans.catalog import _BOTH, _EACH, _ITEMS, _SEARCH, _TOKENS, QUERIES, SQL, _canonical, _fused, _items, _query, _raw, r2_keyword_search, r7_vector_search
from tesserae.sources import bindings

#: Listings with the columns that the catalogue filter reads.
_LISTED = """select id, category_id, city_id, title, case when id % 9 = 0 then 0 else rental_fee end as rental_fee, is_rent_negotiable, deleted_at, created_at as updated_at,
  case id % 3 when 0 then 'wanted' else 'offer' end as type, id % 2 + 1 as category_type, id % 5 as boost_ad_count from ads"""


def _listings(spark, sf_dir, attributes=False):
    """One row a listing; with its ``attributes`` only where a filter reads them."""
    listed = bindings.run(spark, sf_dir, _LISTED, engagement=False)
    if not attributes:
        return listed
    values = _canonical(spark, sf_dir, "ads_attributes").groupBy(F.col("ads_id").alias("id")).agg(F.to_json(F.collect_list(F.struct("value"))).alias("attributes"))
    return listed.join(values, "id", "left")


_LISTED_SQL = f", listed as ({_LISTED}), "
_PRICED = "rental_fee > 1 and rental_fee >= 100 and rental_fee <= 900"
_FILTERS = {
    "category": (CatalogueFilter(equal={"city_id": 3}, category_type=1, text="not looked for"), "city_id = 3 and category_type = 1"),
    "boosted": (CatalogueFilter(category_type=3, negotiable=True), "boost_ad_count > 0 and is_rent_negotiable = 1"),
    "attributes": (CatalogueFilter(attributes=["1", "7", "11"]), "id in (select ads_id from ads_attributes where value in ('1', '7', '11'))"),
    "wanted": (CatalogueFilter(least=100, most=900, types=["wanted"]), f"type = 'wanted' and (({_PRICED}) or rental_fee is null or rental_fee <= 1)"),
    "offers": (CatalogueFilter(least=100, most=900, types=["offer"]), f"type = 'offer' and {_PRICED}"),
    "ids": (CatalogueFilter(ids=[1, 2, 3, 4, 5, 6, 7]), "id between 1 and 7"),
    "text": (CatalogueFilter(text="RED"), "lower(title) like '%red%'"),
}


@_query(_LISTED_SQL + "x as (select 1) " + " union all ".join(f"select '{k}' as filter, count(*) as n, min(id) as first, max(id) as last from listed where deleted_at is null and {sql}" for k, (_, sql) in _FILTERS.items()))
def f10_catalogue_filter(spark, sf_dir):
    rows = _listings(spark, sf_dir, attributes=True)
    parts = [rows.where(f.condition()).agg(F.lit(k).alias("filter"), F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last")) for k, (f, _) in _FILTERS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@_query("select id, title, rental_fee from (select id, title, cast(case when id % 4 = 0 then 'n/a' else cast(rental_fee as varchar) end as varchar) as fee, rental_fee, city_id from ads) x where try_cast(fee as double) > 1 and try_cast(fee as double) between 100 and 500 and city_id = 7")
def f6_metadata_match(spark, sf_dir):
    """Fees of metadata are texts; one that is no number matches no bound."""
    a = _canonical(spark, sf_dir, "ads").withColumn("fee", F.when(F.col("id") % 4 == 0, "n/a").otherwise(F.col("rental_fee").cast("string")))
    return a.where(search.price_matches(F.col("fee").try_cast("double"), 100, 500) & (F.col("city_id") == 7)).select("id", "title", "rental_fee")


@_query("select id from ads where cast(city_id as varchar) in ('1', '2') and rental_fee >= 200 and status = 'O'")
def f7_where_tree(spark, sf_dir):
    return _canonical(spark, sf_dir, "ads").where(search.condition(search.where_tree({"city_id": [1, 2], "status": "O", "state_id": None}, {"rental_fee": (200, None)}))).select("id")


_CLAUSES = {"$ne": ({"status": {"$ne": "O"}}, "status <> 'O'"), "$lt": ({"rental_fee": {"$lt": 90}}, "rental_fee < 90"), "$gt": ({"rental_fee": {"$gt": 2000}}, "rental_fee > 2000"), "$lte_or_null": ({"photos": {"$lte_or_null": 0}}, "photos is null"), "$in": ({"status": {"$in": []}}, "false"), "=": ({"city_id": 4}, "city_id = 4")}


@_query(" union all ".join(f"select '{k}' as clause, count(*) as n from ads where {sql}" for k, (_, sql) in _CLAUSES.items()))
def f19_eval_clauses(spark, sf_dir):
    held = [F.count_if(F.coalesce(search.condition(t), F.lit(False))).alias(k) for k, (t, _) in _CLAUSES.items()]
    one = _canonical(spark, sf_dir, "ads").agg(*held)
    return one.unpivot([], list(_CLAUSES), "clause", "n")


_GROUPS = [{"city_id": 99}, {"city_id": 5, "status": "P"}, {"city_id": 5}]


@_query("select id, g as filter_group from (select id, case when city_id = 99 then 0 when city_id = 5 and status = 'P' then 1 when city_id = 5 then 2 end as g from ads) x where g = (select min(case when city_id = 99 then 0 when city_id = 5 and status = 'P' then 1 when city_id = 5 then 2 end) from ads)")
def f20_filter_groups(spark, sf_dir):
    return search.first_group(_canonical(spark, sf_dir, "ads"), _GROUPS).select("id", "filter_group")


@_query(_LISTED_SQL + "x as (select id, row_number() over (order by case when rental_fee > 1 then rental_fee end asc nulls last, updated_at desc nulls last, id desc) as place from listed where deleted_at is null and city_id = 3) select id from x where place > 5 and place <= 15")
def r3_browse(spark, sf_dir):
    return catalogue.browse(_listings(spark, sf_dir), CatalogueFilter(equal={"city_id": 3}), 10, 5, "price_asc").select("id")


@_query(_LISTED_SQL + "x as (select id, row_number() over (order by updated_at desc nulls last, id desc) as place from listed where deleted_at is null) select id from x where place <= 20")
def o4_catalogue_order(spark, sf_dir):
    return catalogue.browse(_listings(spark, sf_dir), CatalogueFilter(), 20).select("id")


_RANKED = _SEARCH + _LISTED_SQL


@_query(_RANKED + "x as (select 1) select qid, l.id, rank, l.title, l.rental_fee from kw join listed l on l.id = kw.id where l.deleted_at is null and l.type = 'offer'")
def k12_hydrate_filtered(spark, sf_dir):
    return catalogue.hydrate_filtered(r2_keyword_search(spark, sf_dir), _listings(spark, sf_dir), CatalogueFilter(types=["offer"])).select("qid", "id", "rank", "title", "rental_fee")


@_query(_RANKED + "x as (select kw.qid, kw.id, row_number() over (partition by qid order by rank) as rank from kw join listed l on l.id = kw.id where l.type = 'offer') select * from x where rank <= 5")
def r13_eligible(spark, sf_dir):
    return catalogue.eligible(r2_keyword_search(spark, sf_dir), _listings(spark, sf_dir), ["offer"], 5).select("qid", "id", "rank")


@_query(_SEARCH + "select qid, id, row_number() over (partition by qid order by rank, id) as rank from (select qid, id // 2 as id, min(rank) as rank from kw where id % 3 > 0 group by qid, id // 2) x")
def r14_product_ids(spark, sf_dir):
    hits = r2_keyword_search(spark, sf_dir).select("qid", "rank", F.floor(F.col("id") / 2).cast("string").alias("doc_id"), F.when(F.col("id") % 3 > 0, "database").otherwise("file").alias("source_type"), F.lit("products").alias("source_table"))
    return catalogue.product_ids(hits, "database", "products")


_TAIL_SQL = """tail as (select qid, id, row_number() over (partition by qid order by place) as rank from (
  select a.qid, l.id, l.place from (select distinct qid from kw) a cross join (select id, row_number() over (order by updated_at desc nulls last, id desc) as place from listed where deleted_at is null and city_id = 3) l
  where not exists (select 1 from kw where kw.qid = a.qid and kw.id = l.id)) x)"""


@_query(_RANKED + _TAIL_SQL + " select * from tail where rank <= 6")
def r15_related_tail(spark, sf_dir):
    return catalogue.related_tail(r2_keyword_search(spark, sf_dir).select("qid", "id"), _listings(spark, sf_dir), CatalogueFilter(equal={"city_id": 3}), 6)


@_query(_LISTED_SQL + "x as (select id, row_number() over (order by updated_at desc nulls last, id desc) as place from listed where deleted_at is null and city_id = 3 and type = 'offer') select id from x where place <= 10")
def r18_deterministic(spark, sf_dir):
    """A search that its filters say whole: catalogue order, no ranking."""
    return catalogue.browse(_listings(spark, sf_dir), CatalogueFilter(equal={"city_id": 3}, types=["offer"]), 10).select("id")


_ANCHORED = "(select qid, id, row_number() over (partition by qid order by rank) as w from (select r.*, l.city_id, first(l.city_id) over (partition by qid order by rank) as anchor from {0} r join listed l using (id)) a where city_id = anchor)"
_TIERED = _RANKED + f"""head as {_ANCHORED.format("kw")}, hyb as {_ANCHORED.format("fused")}, seen as (select distinct qid, id from (select qid, id from head union all select qid, id from hyb) s),
cat as (select qid, id, row_number() over (partition by qid order by place) as w from (select a.qid, l.id, l.place from (select distinct qid from seen) a
  cross join (select id, row_number() over (order by updated_at desc nulls last, id desc) as place from listed where deleted_at is null and type = 'offer') l where not exists (select 1 from seen where seen.qid = a.qid and seen.id = l.id)) x),
every as (select qid, id, 0 as tier, w from head union all select qid, id, 1, w from hyb union all select qid, id, 2, w from cat where w <= 12 union all select qid, id, 3, rank from fused),
once as (select qid, id, min(tier) as tier, min_by(w, tier) as w from every group by qid, id), results as (select qid, id, tier, row_number() over (partition by qid order by tier, w, id) as rank from once)"""


@_query(_TIERED + " select qid, id, tier, rank from results where rank <= 12")
def r17_search(spark, sf_dir):
    kw, vec = r2_keyword_search(spark, sf_dir), r7_vector_search(spark, sf_dir)
    return catalogue.tiered(kw, search.fuse(vec, kw), _listings(spark, sf_dir), CatalogueFilter(types=["offer"]), "city_id", 12, most=40)  # 20 hits of each


@_query(_TIERED + " select qid, r.id, tier, row_number() over (partition by qid order by tier, case when rental_fee > 1 then rental_fee end desc nulls last, rank) as rank from results r join listed l on l.id = r.id where rank <= 12")
def o5_price_resort(spark, sf_dir):
    found = r17_search(spark, sf_dir).join(_listings(spark, sf_dir).select("id", "rental_fee"), "id")
    return catalogue.price_resorted(found, "price_desc").select("qid", "id", "tier", "rank")


#: Bands that start anew at the first hit outside the one before.
_BANDS = """, page as (select k.qid, k.id, k.{score} as score, k.rank, i.verified from {ranked} k join items i using (id)), walk as (
  select qid, id, score, rank, verified, score as anchor, 1 as band from page where rank = 1
  union all select p.qid, p.id, p.score, p.rank, p.verified, case when w.anchor - p.score > abs(w.anchor) * 0.05 then p.score else w.anchor end, case when w.anchor - p.score > abs(w.anchor) * 0.05 then w.band + 1 else w.band end
  from walk w join page p on p.qid = w.qid and p.rank = w.rank + 1)"""
_WALKED = "row_number() over (partition by qid order by band, case when verified then 0 else 1 end, rank) as rank"


def _recursive(sql: str) -> str:
    return bindings.dialect(sql, False).replace("with ", "with recursive ", 1)


SQL["r19_verified_bands"] = _recursive(_SEARCH + _BANDS.format(score="score", ranked="kw") + f" select qid, id, score, {_WALKED}, verified from walk")
SQL["r19_verified_bands_whole"] = SQL["r19_verified_bands"].replace(_BOTH, _EACH).replace("cross join asked a", "cross join asked_vec a")


def r21_fusion_fallback(spark, sf_dir):
    ranked = _fused(spark, sf_dir).join(_items(spark, sf_dir).select("id", "verified"), "id").withColumn("fusion_score", F.round("fusion_score", 9))
    return catalogue.fallback_ranked(ranked.select("qid", "id", "fusion_score", "rank", "verified")).select("qid", "id", "rank")


QUERIES["r21_fusion_fallback"] = r21_fusion_fallback
SQL["r21_fusion_fallback"] = _recursive(_SEARCH + ", rounded as (select qid, id, round(fusion_score, 9) as fusion_score, row_number() over (partition by qid order by round(fusion_score, 9) desc, rank) as rank from fused join items using (id))" + _BANDS.format(score="fusion_score", ranked="rounded") + f" select qid, id, {_WALKED} from walk")


@_query(_SEARCH + "select qid, id, round(s, 9) as fusion_score, row_number() over (partition by qid order by s desc, rank, id) as rank from (select f.*, fusion_score + case when i.title like '%red%' then 0.12 else 0 end + case when i.text like '%STEEL%' then -0.04 else 0 end as s from fused f join items i using (id)) x")
def p16_adjusted(spark, sf_dir):
    said = _items(spark, sf_dir).select("id", F.col("title").contains("red").alias("red"), F.col("text").contains("STEEL").alias("steel"))  # texts stay where they lie
    return catalogue.adjusted(_fused(spark, sf_dir).join(said, "id"), [(F.col("red"), 0.12), (F.col("steel"), -0.04)]).select("qid", "id", F.round("fusion_score", 9).alias("fusion_score"), "rank")


@_query(f", items as (select *, {_TOKENS.format('text')} as ts from ({_ITEMS}) x), u as (select id, len(ts) as dl, unnest(ts) as term from items), p as (select term, id, dl, count(*) as tf from u group by all) select term, id, dl, tf, count(*) over (partition by term) as df from p")
def r1_postings(spark, sf_dir):
    rows, df = catalogue.postings(_items(spark, sf_dir), tokens(F.col("text")))
    return rows.join(df, "term").select("term", "id", "dl", "tf", "df")


@_query(f", items as (select *, {_TOKENS.format('text')} as ts from ({_ITEMS}) x) select id, title from items where list_contains(ts, 'red') and list_contains(ts, 'ring')")
def j7_postings_join(spark, sf_dir):
    """Listings that hold all of some terms, by their postings."""
    rows, _ = catalogue.postings(_items(spark, sf_dir), tokens(F.col("text")))
    held = rows.where(F.col("term").isin("red", "ring")).groupBy("id").agg(F.count("*").alias("n")).where("n = 2")
    return _items(spark, sf_dir).join(held, "id").select("id", "title")


@_query(", eligible as (select id, rental_fee from ads where city_id = 3), n as (select count(*) as n from eligible) select n, strategy, id from (select n, case when n <= 1000000 then 'exact_filtered' else 'index_filtered' end as strategy from n) s left join (select id from (select id, row_number() over (order by rental_fee desc, id) as r from eligible) x where r <= 5 and (select n from n) <= 1000000) y on true")
def j8_guarded_ranking(spark, sf_dir):
    """Ranked only if few enough rows are eligible; how many are and the way taken come along in any case."""
    a, limit = _canonical(spark, sf_dir, "ads"), 1_000_000
    n = catalogue.count_up_to(a, F.col("city_id") == 3, limit)
    head = spark.createDataFrame([(n, catalogue.strategy(n, True, limit))], "n long, strategy string")
    found = a.where("city_id = 3").orderBy(F.desc("rental_fee"), "id").limit(5 if n <= limit else 0).select("id")
    return head.join(found, F.lit(True), "left")


@_query(_SEARCH + ", page as (select qid, id, rank, count(*) over (partition by qid) as total from kw where id % 2 = 0) select qid, page.id, total, place, p_name as title, p_brand as brand from (select *, row_number() over (partition by qid order by rank) as place from page) page join part on p_partkey = page.id where place > 2 and place <= 6")
def j9_ranked_page(spark, sf_dir):
    """A page of a ranking with the total; only the page's rows fetch their wide columns."""
    kept = r2_keyword_search(spark, sf_dir).where("id % 2 = 0")
    w = Window.partitionBy("qid")
    page = kept.select("qid", "id", F.count("*").over(w).alias("total"), F.row_number().over(w.orderBy("rank")).alias("place")).where("place > 2 and place <= 6")
    wide = _raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"))
    return wide.join(F.broadcast(page), "id").select("qid", "id", "total", "place", "title", "brand")


@_query("select user_id, term, searched_at, place from (select u as user_id, last(q order by t, q) as term, max(t) as searched_at, row_number() over (partition by u order by max(t) desc, f) as place from (select id % 20 as u, query_text as q, created_at as t, lower(trim(query_text)) as f from search_history where trim(query_text) <> '') x group by u, f) y where place <= 3")
def o11_recent_searches(spark, sf_dir):
    s = _canonical(spark, sf_dir, "search_history").select((F.col("id") % 20).alias("user_id"), F.col("query_text").alias("term"), F.col("created_at").alias("searched_at"))
    return catalogue.recent_searches(s, 3)


@_query(_SEARCH + "select qid, id, min(rank) as rank from (select qid, id, rank from kw where rank <= 3 union all select qid, id, 3 + rank from vec where rank <= 3) x group by qid, id")
def u1_ordered_union(spark, sf_dir):
    """One ranking after another, each id at its first place."""
    both = r2_keyword_search(spark, sf_dir).where("rank <= 3").select("qid", "id", "rank").union(r7_vector_search(spark, sf_dir).where("rank <= 3").select("qid", "id", (F.col("rank") + 3)))
    return both.groupBy("qid", "id").agg(F.min("rank").alias("rank"))
