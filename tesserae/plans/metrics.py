"""The metric registry: each a query over the canonical tables, with a total order wherever it is cut.

Those over places of values, the largest keys and mentions of names are in ``plans/spread.py``.
"""

from __future__ import annotations


def _top(expr: str, source: str, k: int, where: str = "true") -> str:
    return f"select {expr} as label, cast(count(*) as bigint) as n from {source} where {where} group by {expr} order by n desc, label limit {k}"




def _cases(x: str, edges: list[float], labels: list[str]) -> str:
    """Right-open buckets with an overflow."""
    return "case " + " ".join(f"when {x} < {e} then '{n}'" for e, n in zip(edges, labels, strict=False)) + f" else '{labels[-1]}' end"


_LEN = "(length(trim(query_text)) - length(replace(trim(query_text), ' ', '')) + 1)"
_LATENCY = _cases("duration_ms", [500, 1000, 2000, 3000, 4000, 5000, 7000, 10000], ["0-0.5s", "0.5-1s", "1-2s", "2-3s", "3-4s", "4-5s", "5-7s", "7-10s", "10s+"])
_RESULTS = _cases("total_results", [1, 6, 11, 21], ["0", "1-5", "6-10", "11-20", "20+"])
_FEES = _cases("rental_fee", [100, 250, 500, 1000, 2500, 5000, 10000, 25000, 50000], ["0-100", "100-250", "250-500", "500-1k", "1k-2.5k", "2.5k-5k", "5k-10k", "10k-25k", "25k-50k", "50k+"])
_GROUP = "case when operation in ('query_planning', 'planning', 'llm', 'chat', 'generation') then 'llm' when operation like 'rerank%' then 'reranker' when operation like 'embedding%' then 'embedding' else 'other' end"
_ZERO = "select h.* from txt h join ok a on a.request_id = h.request_id where a.total_results = 0"

METRICS: dict[str, str] = {
    # search intelligence
    "q7_zero_results": "select cast(count(*) as bigint) as total, cast(count(case when lower(a.status) = 'success' then 1 end) as bigint) as successful, cast(count(case when lower(a.status) = 'success' and a.total_results = 0 then 1 end) as bigint) as zero from txt h left join api_usage a on a.request_id = h.request_id",
    "q12_query_length": f"select {_cases(_LEN, [2, 3, 4, 6, 9], ['1', '2', '3', '4-5', '6-8', '9+'])} as label, cast(count(*) as bigint) as n, round(avg({_LEN}), 6) as avg_words, round(avg(length(query_text)), 6) as avg_chars from txt group by 1",
    "q15_search_volume": "select h.hour, cast(count(t.id) as bigint) as n from (select distinct cast(n_nationkey as int) as hour from nation where n_nationkey < 24) h left join txt t on cast(extract(hour from t.created_at) as int) = h.hour group by h.hour",
    "q88_repeat_demand": "select lower(trim(query_text)) as label, cast(count(*) as bigint) as n from txt group by 1 having count(*) > 1 order by n desc, label limit 20",
    "q88_repeat_totals": "select cast(count(*) as bigint) as unique_queries, cast(count(case when n > 1 then 1 end) as bigint) as repeated from (select lower(trim(query_text)) as q, count(*) as n from txt group by 1) x",
    "q90_complexity_performance": f"select {_cases('w', [2, 3, 5, 8], ['1', '2', '3-4', '5-7', '8+'])} as label, cast(count(*) as bigint) as n, round(avg(duration_ms), 6) as avg_ms, round(100e0 * count(case when total_results = 0 then 1 end) / count(*), 6) as zero_rate from (select {_LEN} as w, a.duration_ms, a.total_results from txt h join ok a on a.request_id = h.request_id) x group by 1",
    "q91_path_outcomes": "select execution_path as label, cast(count(*) as bigint) as requests, cast(count(case when status = 'success' then 1 end) as bigint) as successful, round(100e0 * count(case when status = 'success' and total_results = 0 then 1 end) / nullif(count(case when status = 'success' then 1 end), 0), 6) as zero_rate, round(100e0 * count(case when status <> 'success' then 1 end) / count(*), 6) as failure_rate, round(avg(duration_ms), 6) as avg_ms, round(avg(case when status = 'success' then total_results end), 6) as avg_results from tapi group by execution_path",
    "q92_provider_reliability": "select provider as label, cast(count(case when status = 'success' then 1 end) as bigint) as success, cast(count(case when status = 'fallback' then 1 end) as bigint) as fallback, cast(count(case when status not in ('success', 'fallback') then 1 end) as bigint) as failure from attempts group by provider",
    # API performance
    "q21_success_rate": "select status as label, cast(count(*) as bigint) as n from tapi group by status",
    "q22_execution_paths": "select execution_path as label, cast(count(*) as bigint) as n from tapi group by execution_path",
    "q23_latency_histogram": f"select {_LATENCY} as label, cast(count(*) as bigint) as n from tapi group by 1",
    "q25_det_vs_sem": "select execution_path as label, cast(count(*) as bigint) as n, round(avg(duration_ms), 4) as avg_ms, round(avg(total_results), 6) as avg_results, round(avg(total_tokens), 6) as avg_tokens from tapi where execution_path in ('deterministic_filter', 'semantic', 'direct_semantic') group by execution_path",
    "q26_token_consumption": "select cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens, cast(sum(total_tokens) as bigint) as total_tokens, round(avg(total_tokens), 6) as avg_tokens from tapi",
    "q27_tokens_by_path": "select execution_path as label, round(avg(total_tokens), 6) as avg_total, round(avg(input_tokens), 6) as avg_input, round(avg(output_tokens), 6) as avg_output, cast(sum(total_tokens) as bigint) as total from tapi group by execution_path",
    "q28_provider_usage": "select provider as label, cast(count(*) as bigint) as n from attempts group by provider",
    "q29_provider_reliability": "select provider as label, cast(count(*) as bigint) as n, round(100e0 * count(case when status = 'success' then 1 end) / count(*), 6) as success_rate, round(avg(duration_ms), 4) as avg_ms from attempts group by provider",
    "q30_latency_per_operation": "select operation as label, cast(count(*) as bigint) as n, round(avg(duration_ms), 4) as avg_ms, round(sum(duration_ms), 2) as total_ms from attempts group by operation",
    "q31_model_latency": "select provider || ' / ' || model as label, cast(count(*) as bigint) as n, round(avg(duration_ms), 4) as avg_ms from attempts group by 1",
    "q32_reranking_fallback": "select cast(count(case when operation = 'reranking' then 1 end) as bigint) as reranking, cast(count(case when operation = 'reranking' and status = 'fallback' then 1 end) as bigint) as fallbacks, cast(count(distinct case when status = 'fallback' then request_id end) as bigint) as requests_with_fallback from attempts",
    "q33_failure_reasons": "select failure_reason as label, cast(count(*) as bigint) as n from attempts where coalesce(failure_reason, '') <> '' group by failure_reason",
    "q35_result_distribution": f"select {_RESULTS} as label, cast(count(*) as bigint) as n from ok group by 1",
    "q36_zero_result_rate": "select round(100e0 * count(case when total_results = 0 then 1 end) / nullif(count(*), 0), 6) as zero_rate, cast(count(*) as bigint) as successful from ok",
    "q37_results_by_path": "select execution_path as label, round(avg(total_results), 6) as avg_results from ok group by execution_path",
    "q38_zero_result_queries": f"select request_id, query_text from ({_ZERO}) z",
    "q39_length_vs_results": f"select {_LEN} as words, round(avg(a.total_results), 6) as avg_results from txt h join ok a on a.request_id = h.request_id group by 1 order by words limit 15",
    "q40_avg_api_calls": "select cast(api_call_count as bigint) as label, cast(count(*) as bigint) as n from tapi group by api_call_count",
    "q93_operation_token_usage": f"select {_GROUP} as label, cast(count(*) as bigint) as attempts, cast(sum(greatest(total_tokens, 0)) as bigint) as total_tokens from attempts group by 1",
    # supply and users
    "q47_supply_by_category": _top("cat_name", "named", 20),
    "q48_supply_by_city": _top("city", "named", 25),
    "q50_low_supply_categories": "select cat_name as label, cast(count(*) as bigint) as n from named group by cat_name having count(*) < 5000 order by n, label limit 15",
    "q51_user_growth": "select * from (select {month:created_at} as label, cast(count(*) as bigint) as n from users group by 1 order by label desc limit 36) x",
    "q52_users_by_state": "select coalesce(s.name, 'Unknown') as label, cast(count(*) as bigint) as n from users u left join states s on s.id = u.state_id group by 1 order by n desc, label limit 15",
    "q53_gender_split": "select case gender when 1 then 'Male' when 2 then 'Female' else 'Not Specified' end as label, cast(count(*) as bigint) as n from users group by 1",
    "q54_platform": "select cast(platform as bigint) as label, cast(count(*) as bigint) as n from users group by platform order by n desc, label limit 10",
    "q55_ads_per_user": f"select {_cases('n', [2, 3, 6, 11, 51], ['1', '2', '3-5', '6-10', '11-50', '50+'])} as label, cast(count(*) as bigint) as sellers, cast(max(n) as bigint) as most from (select user_id, count(*) as n from ads group by user_id) x group by 1",
    "q56_verification": "select cast(sum(is_verified) as bigint) as verified, round(100e0 * sum(is_verified) / count(*), 6) as pct from users",
    "q58_products_vs_services": "select case cat_group when 1 then 'Products' when 2 then 'Services' end as label, cast(count(*) as bigint) as n from named group by 1",
    "q59_top_subcategories": _top("sub_name", "named", 20),
    "q60_rental_fee_distribution": f"select {_FEES} as label, cast(count(*) as bigint) as n from ads where rental_fee > 0 group by 1",
    "q61_negotiable": "select cast(count(case when is_rent_negotiable = 1 then 1 end) as bigint) as negotiable, cast(count(*) as bigint) as total from ads",
    "q62_ad_status": "select case status when 'O' then 'Active' when 'F' then 'Closed' when 'P' then 'Pending' else status end as label, cast(count(*) as bigint) as n from ads group by 1",
    "q63_top_ads_by_views": "select id, substr(title, 1, 60) as title, cast(actual_view_count as bigint) as n from ads order by actual_view_count desc, id limit 10",
    "q63_top_ads_by_favourites": "select id, substr(title, 1, 60) as title, cast(total_favorite as bigint) as n from ads order by total_favorite desc, id limit 10",
    "q63_top_ads_by_likes": "select id, substr(title, 1, 60) as title, cast(total_like as bigint) as n from ads order by total_like desc, id limit 10",
    "q64_city_density": "select l.id, l.city, l.price, s.name as state, cast(count(a.id) as bigint) as ads from location l join states s on s.id = l.state_id left join ads a on a.city_id = l.id group by l.id, l.city, l.price, s.name order by l.id limit 25",
    "q65_premium_adoption": "select cast(count(premium_start_date) as bigint) as premium, cast(count(top_start_date) as bigint) as top, cast(count(*) - greatest(count(premium_start_date), count(top_start_date)) as bigint) as free from ads",
    "q66_revenue_by_city": "select city as label, n * price as revenue from (select l.id, l.city, l.price, count(a.id) as n from location l join ads a on a.city_id = l.id group by l.id, l.city, l.price order by l.id limit 20) x order by revenue desc, label limit 15",
    "q67_undermonetized": "select l.city as label, l.price, cast(coalesce(c.n, 0) as bigint) as ads from location l left join (select city_id, count(*) as n from ads group by city_id) c on c.city_id = l.id where l.price >= 75 and coalesce(c.n, 0) < 1000 order by l.price desc, label limit 20",
    "q68_premium_by_category": _top("cat_name", "named", 15, "premium_start_date is not null"),
    "q70_photos": "select cast(count(photos) as bigint) as with_photos, cast(count(*) as bigint) as total from ads",
    "q72_keywords": "select cast(count(keywords) as bigint) as with_keywords, cast(count(*) as bigint) as total from ads",
    "q73_attribute_completeness": "select coalesce(a.name, 'Unknown') as label, cast(count(*) as bigint) as n from ads_attributes x left join attributes a on a.id = x.attribute_id group by 1 order by n desc, label limit 15",
    "q74_common_values": "select substr(coalesce(v.value, x.value), 1, 40) as label, cast(count(*) as bigint) as n from ads_attributes x left join attribute_values v on v.id = try_cast(x.value as bigint) group by 1 order by n desc, label limit 20",
    # market
    "q75_marketplace_overview": "select c.cat_name as label, c.n, c.avg_fee, t.city as top_city from (select cat_name, cast(count(*) as bigint) as n, round(avg(case when rental_fee > 0 then rental_fee end), 4) as avg_fee from named group by cat_name) c join (select cat_name, city, row_number() over (partition by cat_name order by count(*) desc, city) as r from named group by cat_name, city) t on t.cat_name = c.cat_name and t.r = 1",
    "q76_geographic_heatmap": "select city as label, state_name as state, cast(count(*) as bigint) as n from named group by city, state_name order by n desc, label limit 20",
    "q77_top_listings": "select sub_name as label, category_id, city, cast(count(*) as bigint) as n from named group by sub_name, category_id, city order by n desc, label, category_id, city limit 30",
    "q79_temporal_patterns": "select * from (select {month:created_at} as label, cast(count(*) as bigint) as n from ads group by 1 order by label desc limit 36) x",
    "q80_active_listings": "select * from (select {month:created_at} as label, cast(count(*) as bigint) as n from ads where deleted_at is null group by 1 order by label desc limit 36) x",
    "q81_user_acquisition_by_state": "select s.name as label, cast(count(*) as bigint) as n from users u join states s on s.id = u.state_id where u.created_at >= timestamp '1996-02-01' - interval '365' day group by s.name order by n desc, label limit 15",
    "q82_engagement": "select id, substr(title, 1, 60) as title, cast(actual_view_count + 5 * total_favorite + 3 * total_like as bigint) as score from ads order by score desc, id limit 15",
    # generic operators
    "j4_dimension_lookup": "select a.id, coalesce(l.city, 'Unknown (' || cast(a.city_id as {string}) || ')') as city from ads a left join location l on l.id = a.city_id",
    "j12_anti_join": "select u.id from users u where not exists (select 1 from ads a where a.user_id = u.id)",
    "w3_keep_last": "select id, user_id from (select id, user_id, row_number() over (partition by user_id order by created_at desc, id desc) as r from ads) x where r = 1",
    "f5_price_predicate": "select id from ads where (rental_fee > 1 and rental_fee >= 100 and rental_fee <= 500) or rental_fee is null or rental_fee <= 1",
    "o3_browse_page": "select a.id, a.rental_fee from ads a join users u on u.id = a.user_id order by u.is_verified desc, a.id desc limit 50",
    "s13_source_counts": "select coalesce(source, 'unknown') as label, cast(count(*) as bigint) as n from documents group by 1",
    "a20_usage_cube": "select {month:created_at} as month, execution_path, status, cast(count(*) as bigint) as requests, cast(sum(total_tokens) as bigint) as tokens from api_usage group by 1, 2, 3",
}
