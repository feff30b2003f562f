"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A benchmark item is cut into windows of 13 words; a window is the set of its five-word shingles.
To contain a window a text must contain all of its shingles, so its rarest one is the necessary
prefix.  Shingles are ordered by how often the corpus has them; a window with a shingle that the
corpus lacks cannot occur.  The prefix shingles meet the texts' shingles; the place in the text and
the place in the window fix where the window would start (positional bound) and whether it fits
(length bound); the words there are then compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_unique, words, written

WINDOW = 13
SHINGLE = 5
#: After lower-casing, digits, a-z and everything beyond ASCII make words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Shingles of windows (16 bytes each), and bytes of the windows' words, that are sent to every executor; more are shuffled.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def item_words(text: Column) -> Column:
    return words(ascii_lower(F.coalesce(text, F.lit(""))), GAP)


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart that repeat an id or have none; equal rows have equal results."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _shingles(k: int) -> Column:
    """Hashes of the k words from each place of ``w`` on; those past the end are of fewer words."""
    return F.transform("w", lambda x, i: F.xxhash64(x, *[F.get("w", i + j) for j in range(1, k)]))


def _windows(benchmark: DataFrame, item_col: str, text_col: str, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``(wid, win, size, k)`` and who has them ``(wid, item_id)``."""
    items = benchmark.select(F.col(item_col).alias("item_id"), item_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    each = items.select("item_id", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"))
    each = each.select("item_id", F.slice("w", F.col("at"), F.col("size")).alias("win"), "size")
    each = each.select("item_id", F.sha2(F.concat_ws(" ", "win"), 256).alias("wid"), "win", "size", F.least("size", F.lit(k)).alias("k"))
    each = written(each.distinct(), "decontaminate-windows")
    return each.select("wid", "win", "size", "k").distinct(), each.select("wid", "item_id").distinct()


def _text_shingles(docs: DataFrame, id_col: str, text_col: str, lengths: list[int], carry: bool) -> DataFrame:
    """Every text's shingles of each length with their places; ``carry`` keeps the words beside them."""
    base = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("rk"), item_words(F.col(text_col)).alias("w"))
    if len(lengths) == 1:
        base = base.select("doc_id", "rk", "w", F.lit(lengths[0]).alias("k"), _shingles(lengths[0]).alias("hs"))
    else:
        each = F.array(*[F.struct(F.lit(k).alias("k"), _shingles(k).alias("hs")) for k in lengths])
        base = base.select("doc_id", "rk", "w", F.inline(each))
    kept = ["doc_id", "rk", "w"] if carry else ["doc_id", "rk"]
    # outer: else a filter on the array's size is inferred and pushed below, where the words are split anew for every word
    return base.select(*kept, "k", F.posexplode_outer("hs").alias("pos", "h"))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Where windows occur, ``(doc_id, rk, wid, start, size)``, and the items of each window, ``(wid, item_id)``.

    ``start`` counts words from 0.  Both are tables in the shared folder.
    """
    windows, owners = _windows(benchmark, item_col, item_text_col, window, k)
    lengths = sorted(r[0] for r in windows.select("k").distinct().collect())  # at most k values
    if not lengths:
        lengths = [k]
    pieces = []
    for n in lengths:
        own = windows.where(F.col("k") == n).withColumn("w", F.col("win"))
        pieces.append(own.select("wid", "win", "size", "k", F.posexplode(F.slice(_shingles(n), F.lit(1), F.col("size") - n + 1)).alias("offset", "h")))
    parts = pieces[0]
    for p in pieces[1:]:
        parts = parts.union(p)
    parts = written(parts, "decontaminate-shingles")
    asked = written(parts.select("k", "h").distinct(), "decontaminate-asked")
    held = windows.agg(F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "win"))), F.lit(0))).first()[0]
    small = parts.count() <= broadcast_rows and held <= BROADCAST_BYTES
    side = F.broadcast if small else (lambda x: x)
    found = _text_shingles(docs, id_col, text_col, lengths, False).join(side(asked), ["k", "h"])
    rarity = written(found.groupBy("k", "h").agg(F.count("*").alias("seen")), "decontaminate-rarity")

    ranked = parts.join(rarity, ["k", "h"], "left").groupBy("wid").agg(
        F.min_by(F.struct("k", "h", "offset", "win", "size"), F.struct(F.coalesce("seen", F.lit(0)), "h", "offset")).alias("p"),
        F.min(F.coalesce("seen", F.lit(0))).alias("least"),
    )
    prefix = written(ranked.where("least > 0").select("wid", "p.*"), "decontaminate-prefix")
    start = (F.col("pos") - F.col("offset")).alias("start")
    if small:
        met = _text_shingles(docs, id_col, text_col, lengths, True).join(F.broadcast(prefix), ["k", "h"])
        met = met.where((F.col("pos") >= F.col("offset")) & (F.col("pos") - F.col("offset") + F.col("size") <= F.size("w")))
        met = met.where(F.slice("w", F.col("pos") - F.col("offset") + 1, F.col("size")) == F.col("win")).select("doc_id", "rk", "wid", start, "size")
    else:
        met = _text_shingles(docs, id_col, text_col, lengths, False).join(prefix, ["k", "h"]).where("pos >= offset").select("rk", "wid", start, "size", "win")
        base = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("rk"), item_words(F.col(text_col)).alias("w"))
        met = met.distinct().join(base, "rk").where("start + size <= size(w)")
        met = met.where(F.slice("w", F.col("start") + 1, F.col("size")) == F.col("win")).select("doc_id", "rk", "wid", "start", "size")
    return written(met.distinct(), "decontaminate-matches"), owners


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: ``doc_id, rk, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word is hit if it lies in any occurrence of a window of an item.  ``contaminated`` is true if
    any word is hit and hits are at least a twentieth of the words.  Null and wordless texts have no
    words and are clean; wordless items are ignored; with an empty benchmark all are clean.  Rows
    that repeat an id are judged each by its own text (``rk`` tells them apart).  Items that repeat
    an id count once.  Other columns are ignored.
    """
    found, owners = matches(docs, benchmark, id_col, text_col, **options)
    place = found.select("rk", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("place"))
    hits = place.distinct().groupBy("rk").agg(F.count("*").alias("hit"))
    # a window that much of the corpus has is a hot key: one row of items for each window
    owned = owners.groupBy("wid").agg(F.collect_set(F.col("item_id").cast("string")).alias("own"))
    named = join_unique(found, owned, "wid").select("rk", F.explode("own").alias("item")).distinct()
    items = named.groupBy("rk").agg(F.count("*").alias("items"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("item"))), 256).alias("sha"))
    judged = written(hits.join(items, "rk"), "decontaminate-judged")
    base = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("rk"), F.size(item_words(F.col(text_col))).cast("long").alias("n_words"))
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return base.join(judged, "rk", "left").select(
        "doc_id",
        "rk",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated."""
    judged = contamination(docs, benchmark, id_col, text_col)
    gone = written(judged.where("contaminated").select("rk").distinct(), "decontaminate-gone")
    return docs.join(gone, row_key(id_col, text_col) == gone["rk"], "left_anti").select(docs.columns)
