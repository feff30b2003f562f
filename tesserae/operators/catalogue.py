"""The catalogue side of search: filters over listings, their order and pages, tails and tiers of results."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import like_escaped
from tesserae.operators import search

#: The category type that stands for boosted listings of any type.
BOOSTED = 3


def all_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def json_contains(attributes: Column, values: Sequence[str]) -> Column:
    """Whether a JSON list of objects has one whose ``value`` is among ``values``; false for what is no such list."""
    listed = F.from_json(attributes, "array<struct<value:string>>")
    return F.coalesce(F.exists(listed, lambda x: x["value"].isin(list(values))), F.lit(False))


@dataclass(frozen=True)
class CatalogueFilter:
    """What a listing must have.  ``equal`` holds categorical columns and their values."""

    equal: Mapping[str, object] = field(default_factory=dict)
    category_type: int | None = None
    attributes: Sequence[str] = ()
    least: float | None = None
    most: float | None = None
    types: Sequence[str] = ()
    negotiable: bool | None = None
    ids: Sequence[int] | None = None
    text: str = ""

    def condition(self) -> Column:
        """The filter over a listing's columns; listings that are deleted never match.

        The text is looked for in the title only where no categorical filter says what is wanted.
        Listings without a price match price bounds if listings that are wanted are asked for.
        """
        parts = [F.col("deleted_at").isNull(), *[F.col(c) == v for c, v in self.equal.items()]]
        if self.category_type is not None:
            parts.append(F.col("boost_ad_count") > 0 if self.category_type == BOOSTED else F.col("category_type") == self.category_type)
        if self.attributes:
            parts.append(json_contains(F.col("attributes"), self.attributes))
        if self.least is not None or self.most is not None:
            parts.append(search.price_matches(F.col("rental_fee"), self.least, self.most, unpriced="wanted" in self.types))
        if self.types:
            parts.append(F.col("type").isin(list(self.types)))
        if self.negotiable is not None:
            parts.append(F.col("is_rent_negotiable") == int(self.negotiable))
        if self.ids is not None:
            parts.append(F.col("id").isin(list(self.ids)) if self.ids else F.lit(False))
        if self.text and not self.equal and self.category_type is None:
            parts.append(F.lower("title").like(f"%{like_escaped(self.text.lower())}%"))
        return all_of([F.coalesce(p, F.lit(False)) for p in parts])


def ordered(items: DataFrame, sort: str | None = None) -> list[Column]:
    """The catalogue's order: newest first, or by price with the unpriced last; then by falling id."""
    newest = [F.col("updated_at").desc_nulls_last(), F.col("id").desc()]
    if sort is None:
        return newest
    fee = F.when(F.col("rental_fee").cast("double") > search.UNPRICED_CEILING, F.col("rental_fee").cast("double"))
    return [fee.asc_nulls_last() if sort == "price_asc" else fee.desc_nulls_last(), *newest]


def browse(items: DataFrame, wanted: CatalogueFilter, k: int, offset: int = 0, sort: str | None = None, category: tuple[str, object] | None = None) -> DataFrame:
    """A page of matching listings.  A soft category that contradicts the filter's own gives nothing."""
    name, value = category or (None, None)
    if name in wanted.equal and wanted.equal[name] != value:
        return items.limit(0)
    where = wanted.condition() if name is None else wanted.condition() & (F.col(name) == value)
    return items.where(where).orderBy(*ordered(items, sort)).offset(offset).limit(k)


def hydrate_filtered(ranked: DataFrame, items: DataFrame, wanted: CatalogueFilter) -> DataFrame:
    """The ranked listings that match, with their columns, in the ranking's order."""
    return ranked.join(items.where(wanted.condition()), "id").orderBy("qid", "rank")


def product_ids(hits: DataFrame, source: str, table: str) -> DataFrame:
    """Listing ids of hits that come from one source table, first seen first: ``qid, id, rank``."""
    fits = (F.col("source_type") == source) & (F.col("source_table") == table) & F.col("doc_id").try_cast("long").isNotNull()
    first = hits.where(fits).groupBy("qid", F.col("doc_id").try_cast("long").alias("id")).agg(F.min("rank").alias("seen"))
    return first.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("seen", "id")).alias("rank"))


def eligible(ranked: DataFrame, items: DataFrame, types: Sequence[str], k: int) -> DataFrame:
    """The first k hits of the allowed types: what is not allowed goes before the cut."""
    kept = ranked.join(items.where(F.col("type").isin(list(types))).select("id"), "id", "left_semi")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("rank") <= k)


def related_tail(seen: DataFrame, items: DataFrame, wanted: CatalogueFilter, k: int, sort: str | None = None, most: int | None = None) -> DataFrame:
    """After a query's hits, the first k other matching listings in catalogue order: ``qid, id, rank``.

    The filter must say something.  One ordered page serves all queries: of its first listings, as many
    as k and the most hits of any query, each query takes those it has not seen.  ``most`` is a number
    that no query's hits exceed, if one is known: else they are counted first.
    """
    if wanted == CatalogueFilter():
        raise ValueError("a tail needs a constraint")
    if most is None:
        most = seen.groupBy("qid").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    page = items.where(wanted.condition()).orderBy(*ordered(items, sort)).limit(k + most)
    page = page.select("id", F.row_number().over(Window.orderBy(*ordered(items, sort))).alias("place"))  # a page of bounded size
    every = seen.select("qid").distinct().join(F.broadcast(page), F.lit(True)).join(seen.select("qid", "id"), ["qid", "id"], "left_anti")
    return every.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("place")).alias("rank")).where(F.col("rank") <= k)


def anchored(ranked: DataFrame, items: DataFrame, category: str) -> DataFrame:
    """The hits that share the category of their query's best hit: ``qid, id, rank``."""
    known = ranked.join(items.select("id", F.col(category).alias("category")), "id")
    best = F.min_by("category", "rank").over(Window.partitionBy("qid"))
    kept = known.withColumn("anchor", best).where("category = anchor")
    return kept.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("rank")).alias("rank"))


def tiered(primary: DataFrame, hybrid: DataFrame, items: DataFrame, wanted: CatalogueFilter, category: str, k: int, most: int | None = None) -> DataFrame:
    """A search's results: the primary ranking's anchored hits, the rest of the hybrid ranking in that
    category, catalogue listings, and last the hits without an anchor: ``qid, id, tier, rank``, k a query.

    Both rankings meet the listings in one join; ``most`` is as in ``related_tail``.
    """
    placed = lambda r, t: r.select("qid", "id", F.lit(t).alias("tier"), F.col("rank").alias("within"))
    known = placed(primary, 0).unionByName(placed(hybrid, 1)).join(items.select("id", F.col(category).alias("category")), "id")
    best = F.min_by("category", "within").over(Window.partitionBy("qid", "tier"))
    near = known.withColumn("anchor", best).where("category = anchor").select("qid", "id", "tier", "within")
    tail = related_tail(near.select("qid", "id").distinct(), items, wanted, k, most=most)
    both = near.unionByName(placed(tail, 2)).unionByName(placed(hybrid, 3))
    return search.first_places(both).where(F.col("rank") <= k)


def price_resorted(results: DataFrame, sort: str) -> DataFrame:
    """``rank`` anew: by price within a tier, the unpriced last, otherwise as before."""
    fee = F.when(F.col("rental_fee") > search.UNPRICED_CEILING, F.col("rental_fee"))
    by = fee.asc_nulls_last() if sort == "price_asc" else fee.desc_nulls_last()
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("tier", by, "rank")))


def with_degradation(vector: Callable[[], DataFrame], keyword: Callable[[], DataFrame]) -> tuple[DataFrame, list[str]]:
    """Both rankings fused; one alone if the other cannot be made; the error if neither can."""
    made, errors = [], []
    for leg in (vector, keyword):
        try:
            made.append(leg())
        except Exception as error:  # noqa: BLE001
            made.append(None)
            errors.append(str(error))
    if len(errors) == 2:
        raise RuntimeError("; ".join(errors))
    empty = next(m for m in made if m is not None).limit(0)
    return search.fuse(*[empty if m is None else m for m in made]), errors


def fallback_ranked(ranked: DataFrame) -> DataFrame:
    """Hits without a reranker: by fusion score, or by place where there is none, then verified ones first within a band."""
    score = F.coalesce("fusion_score", 1.0 / F.col("rank"))
    scored = ranked.withColumn("score", score)
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "rank")
    return search.verified_first(scored.withColumn("rank", F.row_number().over(order)), "score", "verified")


def strategy(eligible_rows: int, filtered: bool, exact_limit: int) -> str:
    """How to search vectors: exactly where few rows are eligible, else by the index, filtered if it can be."""
    if not filtered:
        return "index"
    return "exact_filtered" if eligible_rows <= exact_limit else "index_filtered"


def count_up_to(items: DataFrame, where: Column, limit: int) -> int:
    """The number of matching rows, or ``limit + 1`` if there are more: no more are read than that."""
    return items.where(where).limit(limit + 1).count()


def adjusted(ranked: DataFrame, rules: Sequence[tuple[Column, float]]) -> DataFrame:
    """Fusion scores with what each rule that holds adds, ranked anew."""
    score = reduce(lambda s, r: s + F.when(F.coalesce(r[0], F.lit(False)), F.lit(float(r[1]))).otherwise(0.0), rules, F.col("fusion_score"))
    scored = ranked.withColumn("fusion_score", score)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("fusion_score").desc(), "rank", "id")))


def merged_filters(inferred: Mapping[str, object], explicit: Mapping[str, object], parents: Mapping[str, str]) -> dict[str, object]:
    """Explicit filters override inferred ones; an inferred parent or child of an explicit filter is cleared."""
    said = {k: v for k, v in explicit.items() if v not in (None, "")}

    def related(a: str, b: str) -> bool:
        up = a
        while up in parents:
            up = parents[up]
            if up == b:
                return True
        return False

    kept = {k: v for k, v in inferred.items() if v not in (None, "") and not any(related(k, s) or related(s, k) for s in said)}
    return kept | said


def recent_searches(searches: DataFrame, k: int) -> DataFrame:
    """Each user's newest k different searches, without regard to case: ``user_id, term, searched_at``."""
    last = searches.where(F.trim("term") != "").groupBy("user_id", F.lower(F.trim("term")).alias("folded")).agg(F.max(F.struct("searched_at", "term")).alias("l"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("l.searched_at").desc(), "folded"))
    return last.withColumn("place", place).where(F.col("place") <= k).select("user_id", "l.term", "l.searched_at", "place")


def postings(items: DataFrame, tokens: Column, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """A keyword index: ``term, id, tf, dl`` and ``term, df``."""
    cut = items.select(F.col(id_col).alias("id"), tokens.alias("ts")).select("id", F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    rows = cut.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    return rows, rows.groupBy("term").agg(F.count("*").alias("df"))
