"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each source has a token budget.  As many complete epochs as fit come first; the rest is filled by
a weighted sample without replacement: a document's key is an exponential variate divided by its
quality weight, and documents are taken in order of their keys until the budget is reached.

A source may hold a third of all rows, so its keys are never sorted in one task.  Keys are cut into
slots by a monotone map; sizes are summed by source and slot; prefix sums over slots find the one
slot in which the budget ends.  That slot is cut again until few rows lie in it, whatever the weights
are, and only those are sorted; rows equal in every respect are one row with a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import expanded, words, written

#: Weights of the sources in code point order, again and again.
WEIGHTS = (5.0, 2.0, 1.0)
#: A document is taken at most so many times.
REPEATS = 3
#: Slots into which a source's keys, and then the slot where its budget ends, are cut.
SLOTS = 4096
#: Rows that are sorted in one task, at most, unless their keys are equal.
EDGE_ROWS = 100_000


def quality_weight(text: Column) -> Column:
    """Between 0.05 and 1: falls with the share of symbols that prose hardly has."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))
    return F.greatest(F.lit(0.05), 1.0 / (1.0 + 20.0 * symbols / F.greatest(F.char_length(text), F.lit(1))))


def uniform(*parts: Column) -> Column:
    """A reproducible number in (0, 1) for these values: 52 bits of their MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, total_share: float = 1.0) -> DataFrame:
    """``sizes(src, source_size)`` with ``target``: weighted shares of the total, none above ``repeats`` sizes.

    What a capped source cannot take is shared again among the others by weight.  In closed form: the
    level per weight rises until the total is shared out; sources cap in order of cap over weight.
    """
    everyone = Window.orderBy(F.col("src").asc_nulls_last())
    place = F.row_number().over(everyone)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", repeats * F.col("source_size").cast("double"))
    s = s.withColumn("at", F.col("cap") / F.col("weight"))
    by_cap = Window.orderBy("at", F.col("src").asc_nulls_last())
    all_rows = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(all_rows).cast("double") * total_share
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / open_weight).withColumn("fits", F.col("level") <= F.col("at"))
    s = s.withColumn("final", F.min(F.when(F.col("fits"), F.struct("at", "level"))).over(all_rows)["level"])
    return s.select("src", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def _edges(base: DataFrame, plan: DataFrame, slots: int, edge_rows: int) -> DataFrame:
    """``plan(s, rest, ...)`` with the range ``[low, high)`` of places in which each source's budget ends, and what comes before it.

    Null where a source's rows end at or before its budget.
    """
    plan = plan.withColumns({"low": F.lit(0.0), "high": F.lit(1.0), "before": F.lit(0).cast("long")})
    kept = [c for c in plan.columns if c not in ("low", "high", "before")]
    while True:
        inside = base.join(plan, F.col("src").eqNullSafe(F.col("s"))).where("place >= low and place < high")
        slot = F.least(F.floor((F.col("place") - F.col("low")) / (F.col("high") - F.col("low")) * slots), F.lit(slots - 1)).cast("int")
        sums = inside.groupBy("s", slot.alias("slot")).agg(F.sum("size").alias("slot_size"), F.count("*").alias("rows"), F.min("place").alias("first"), F.max("place").alias("last"))
        before = Window.partitionBy("s").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("lower", F.coalesce(F.sum("slot_size").over(before), F.lit(0)))
        sums = sums.withColumnRenamed("s", "t").join(plan.select("s", "rest", "before"), F.col("t").eqNullSafe(F.col("s")))
        cut = sums.withColumn("lower", F.col("lower") + F.col("before")).where("lower <= rest and rest < lower + slot_size")
        cut = cut.groupBy("t").agg(F.min(F.struct("slot", "lower", "rows", "first", "last")).alias("c")).select("t", "c.*")
        # a slot's range: from its least place to just beyond its largest
        beyond = F.col("last") * (1 + 2.0**-52) + 2.0**-1000
        plan = plan.select(*kept).join(cut, F.col("s").eqNullSafe(F.col("t")), "left").select(*kept, F.col("first").alias("low"), beyond.alias("high"), F.col("lower").alias("before"), "rows", (F.col("first") < F.col("last")).alias("splits"))
        plan = written(plan, "mix-plan")
        most = plan.where("splits").agg(F.max("rows")).first()[0] or 0
        plan = plan.drop("rows", "splits")
        if most <= edge_rows:
            return plan


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 17, quality: Column | None = None, slots: int = SLOTS, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, size, source, source_size, target, taken, copies, key, rk``.

    ``size`` is the number of words (null: 0).  ``taken`` is the number of words that the mix takes,
    repeats counted: ``size`` times the complete epochs, and once more if the document's turn comes
    before its source's budget is used up; the document at the border is taken if that brings the source
    nearer to its target.  ``quality`` is the documents' weight, a column of positive numbers such as a
    classifier's score; by default the share of plain characters.  Only ``repeats`` complete epochs are
    ever taken.  Null is a source of its own, the last.  Sources without words have target 0.  Ties of
    the key are broken by id and text, so reruns agree; rows equal in id, text and source are told apart
    by a running number.  Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.size(words(F.col(text_col))).cast("long")
    weight = F.greatest(F.coalesce((quality_weight(F.col(text_col)) if quality is None else quality).cast("double"), F.lit(0.0)), F.lit(1e-6))
    u = uniform(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.crc32(text))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("src"), size.alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rk"), (-F.log(u) / weight).alias("key"))
    base = written(base.withColumn("place", F.col("key") / (1 + F.col("key"))), "mix-keys")
    sources = written(targets(base.groupBy("src").agg(F.sum("size").alias("source_size")), weights, repeats), "mix-targets")
    plan = sources.withColumnRenamed("src", "s").withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.when(F.col("epochs") >= repeats, 0.0).otherwise(F.col("target") - F.col("epochs") * F.col("source_size")))
    rows = base.join(_edges(base, plan, slots, edge_rows), F.col("src").eqNullSafe(F.col("s"))).drop("s")
    at_edge = F.col("low").isNotNull() & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))
    # a source without an edge has its whole rest taken (its sizes end at the budget) or nothing
    whole = F.when(F.col("low").isNull(), F.col("rest") > 0).otherwise(F.col("place") < F.col("low"))
    plain = rows.where(~at_edge).withColumn("more", whole.cast("long"))
    same = ["src", "key", "doc_id", "rk", "size", "source_size", "target", "epochs", "rest", "before"]
    edge = rows.where(at_edge).groupBy(*same).agg(F.count("*").alias("held"))
    turn = Window.partitionBy("src").orderBy("key", F.col("doc_id").asc_nulls_last(), "rk").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("start", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("held")).over(turn), F.lit(0)))
    # of a row and its copies, all that end within the budget, and the one at the border if that is nearer
    left = F.col("rest") - F.col("start")
    full = F.when(F.col("size") > 0, F.greatest(F.floor(left / F.col("size")), F.lit(0))).otherwise(F.when(left >= 0, F.col("held")).otherwise(0))
    over = left - full * F.col("size")
    nearer = (F.col("size") > 0) & (over > 0) & (F.col("size") - over < over)
    edge = expanded(edge.withColumn("take", full + nearer.cast("long")), "held", "index").withColumn("more", (F.col("index") < F.col("take")).cast("long"))
    names = ["doc_id", "size", "src", "source_size", "target", "epochs", "more", "key", "rk"]
    both = plain.select(names).unionByName(edge.select(names))
    copies = F.col("epochs") + F.col("more")
    return both.select("doc_id", "size", F.col("src").alias("source"), "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "key", "rk")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, with all their columns, each as often as it is taken.

    Rows without words are never taken by a budget of words; they stay once.  Rows equal in id, text
    and source are taken as often as all of them are, as copies of the least of them.
    """
    each = F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))
    plan = mix(docs, id_col, text_col, source_col, **options).groupBy(F.col("doc_id").alias("id of the mix"), F.col("source").alias("source of the mix"), "rk").agg(F.sum(each).alias("copies of the mix"), F.count("*").alias("rows of the mix"))
    plan = written(plan.where("`copies of the mix` <> 1 or `rows of the mix` > 1"), "mix-copies")
    at = (F.xxhash64(F.col(id_col), F.col(text_col)) == plan["rk"]) & docs[id_col].eqNullSafe(plan["id of the mix"]) & docs[source_col].eqNullSafe(plan["source of the mix"])
    joined = docs.join(plan, at, "left").select(*[docs[c] for c in docs.columns], "copies of the mix", "rows of the mix")
    alone = joined.where("coalesce(`rows of the mix`, 1) = 1").withColumn("copies of the mix", F.coalesce("copies of the mix", F.lit(1).cast("long"))).where("`copies of the mix` > 0")
    alone = alone.withColumn("copy of the mix", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies of the mix"))))  # few: no row is taken more than ``repeats`` times
    if plan.where("`rows of the mix` > 1").isEmpty():
        return alone.select(docs.columns)
    key = [id_col, text_col, source_col]
    others = [c for c in docs.columns if c not in key]
    least = joined.where("`rows of the mix` > 1").groupBy(*key, "copies of the mix").agg(F.min(F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])).alias("least of the copies"))
    least = least.select(*key, *[F.col("least of the copies")[f"c{i}"].alias(c) for i, c in enumerate(others)], "copies of the mix")
    least = written(least.where("`copies of the mix` > 0"), "mix-repeated")
    return alone.select(docs.columns).unionByName(expanded(least, "copies of the mix", "copy of the mix").select(docs.columns))
