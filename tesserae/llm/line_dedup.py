"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Lines are compared lower-cased, whitespace aside.  The edit bound is an eighth of a line, one edit: a
line of eight words or more may differ by one word, a shorter one of eight characters or more by one
character, inserted, deleted or replaced; a digit is no slip of a character.  Shorter lines are copies
only when equal.  A line's neighbourhood is the line and the line without each of its elements (words
or characters), as hashed keys; lines with an equal key are near copies.  Steps:

1.  Lines that are equal (by 128 bits of hash) are one; the earliest (by document id, then line)
    stands for all.
2.  One edit leaves one half of a line alone.  Only lines that share a half with another line go on,
    so that the many lines without any near copy emit no variants.
3.  The variants of the rest meet by key.  Keys are summed from element hashes in constant time; those
    that two lines share are spelled out, which verifies the edit, and grouped by their elements.
4.  In a group every two lines are within the bound, so each is a copy of the group's earliest: a
    group of g lines costs g rows, not g * g.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: One word in so many may differ, and in lines of fewer words one character in as many.
MIN_WORDS = 8
#: Places of lines with a possible near copy (24 bytes each) that are sent to every executor; more are shuffled.
BROADCAST_ROWS = 500_000
#: Separators of words within a line, other than the space.
GAPS = "\t\x0b\x0c\r"


def _word_count(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _half_keys(unit: str, size: Column, first, last) -> Column:
    """Hashes of the first and last half, for the line as the longer of two by an element and as the shorter or equal one."""

    def pair(size: Column) -> list[Column]:
        half = F.floor(size / 2).cast("int")
        return [F.xxhash64(F.lit(unit + " first"), size, first(half)), F.xxhash64(F.lit(unit + " last"), size, last((size - half).cast("int")))]

    return F.array(*pair(size), *pair(size - 1))


def _halves(by_word: Column, min_words: int) -> Column:
    """The half keys of ``line`` by words, or by characters where it has few words; null where it is too short for an edit."""
    cut = lambda n: F.call_function("substring_index", F.col("line"), F.lit(" "), n)
    size = F.char_length("line")
    by_char = _half_keys("character", size, lambda n: F.left(F.col("line"), n), lambda n: F.right(F.col("line"), n))
    return F.when(by_word, _half_keys("word", F.col("n"), cut, lambda n: cut(-n))).when(size >= min_words, by_char)


def _raw_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All lines that have a word, with their place; a text of n newlines has n + 1 lines."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rk"), F.split(F.col(text_col), "\n").alias("ls"))
    t = t.select("doc_id", "rk", F.posexplode("ls").alias("line_no", "line"))
    spaced = F.when(F.col("line").rlike(f"[{GAPS}]"), F.translate("line", GAPS, " " * len(GAPS))).otherwise(F.col("line"))
    return t.select("doc_id", "rk", "line_no", F.trim(spaced).alias("line")).where("line <> ''")


def _normal(line: Column) -> Column:
    """Lower-cased, with one space between words; no regular expression where nothing is to be done."""
    single = F.concat_ws(" ", F.array_remove(F.split(line, " "), ""))
    return ascii_lower(F.when(line.contains("  "), single).otherwise(line))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Lines to drop: rows ``(rk, doc_id, line_no, reason)``, reason ``exact`` or ``near``.

    A line is dropped if an earlier one, by document id (null last), a hash of the document and line
    number, equals it or is within one edit.  The earlier one may itself be dropped, so in a chain of
    edits only the first line is sure to stay.
    """
    all_lines = _raw_lines(docs, id_col, text_col).withColumn("line", _normal(F.col("line"))).withColumn("n", _word_count(F.col("line")))
    place = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("doc_id"), F.col("rk").alias("rk"), F.col("line_no").alias("line_no"))
    row = all_lines.select(F.unhex(F.md5("line")).alias("h"), place.alias("place"), _halves(F.col("n") >= min_words, min_words).alias("halves"))
    row = row.select("h", "place", *[F.get("halves", i).alias(f"k{i}") for i in range(4)])
    row = written(row, "lines-keys")
    first = written(row.groupBy("h").agg(F.min("place").alias("first"), *[F.first(f"k{i}").alias(f"k{i}") for i in range(4)]), "lines-first")

    keys = first.where("k0 is not null").select("h", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("k", "key"))
    twice = keys.groupBy("key").agg((F.min("h") < F.max("h")).alias("shared")).where("shared").select("key")
    halves_met = keys.join(twice, "key", "left_semi").groupBy("h").agg(*[F.bool_or(F.col("k") == i).alias(f"s{i}") for i in range(4)])
    open_ = written(halves_met.join(first.select("h", "first"), "h").select("h", "first.*", "s0", "s1", "s2", "s3"), "lines-open")
    # their words again, from the documents that hold their first occurrence
    where = open_.drop("null", "doc_id")
    where = F.broadcast(where) if open_.count() <= BROADCAST_ROWS else where
    text = _raw_lines(docs, id_col, text_col).join(where, ["rk", "line_no"])
    text = text.select("h", "s0", "s1", "s2", "s3", _normal(F.col("line")).alias("line")).dropDuplicates(["h"])
    by_word = _word_count(F.col("line")) >= min_words
    letters = F.slice(F.split("line", ""), F.lit(1), F.char_length("line"))
    words = written(text.select("h", "s0", "s1", "s2", "s3", by_word.alias("by_word"), F.when(by_word, F.split("line", " ")).otherwise(letters).alias("w")), "lines-words")
    total = F.aggregate(F.transform("w", lambda x, i: F.xxhash64(x)), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    held = words.select("h", "w", "by_word", F.size("w").alias("n"), total.alias("all"), "s0", "s1", "s2", "s3")
    # an edit that leaves the first half alone lies in the last one: cuts in a half whose other half met nothing are not emitted
    cuts = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda c: F.col("by_word") | ~c["x"].rlike("[0-9]"))
    half, short_half = F.floor(F.col("n") / 2), F.floor((F.col("n") - 1) / 2)
    at = F.filter(cuts, lambda c: F.when(c["i"] >= half, F.col("s0")).otherwise(F.col("s1")))
    less = F.filter(cuts, lambda c: ((c["i"] >= short_half) & F.col("s2")) | ((c["i"] <= short_half) & F.col("s3")))
    whole = F.filter(F.array(F.lit(-1)), lambda c: F.col("s0") | F.col("s1"))
    # less one word, at its place (a replaced word) or anywhere (a deleted one); the whole line meets lines longer by a word
    without = lambda c: F.col("all").bitwiseXOR(F.xxhash64(c["x"]))
    variants = F.concat(
        F.transform(at, lambda c: F.struct(F.xxhash64(F.lit("at"), F.col("by_word"), F.col("n"), c["i"], without(c)).alias("key"), c["i"].alias("cut"), F.lit("at").alias("way"))),
        F.transform(less, lambda c: F.struct(F.xxhash64(F.lit("less"), F.col("by_word"), F.col("n") - 1, without(c)).alias("key"), c["i"].alias("cut"), F.lit("less").alias("way"))),
        F.transform(whole, lambda c: F.struct(F.xxhash64(F.lit("less"), F.col("by_word"), F.col("n"), F.col("all")).alias("key"), c.alias("cut"), F.lit("less").alias("way"))),
    )
    emitted = written(held.select("h", F.explode(variants).alias("v")).select("h", "v.*"), "lines-variants")
    # deleted-word variants of two lines of equal length are two edits apart: a whole line must be among them
    paired = (F.min("way") == "at") | (F.bool_or(F.col("cut") < 0) & F.bool_or(F.col("cut") >= 0))
    met = emitted.groupBy("key").agg(((F.min("h") < F.max("h")) & paired).alias("shared")).where("shared").select("key")
    met = emitted.join(met, "key", "left_semi")
    left = F.when(F.col("cut") < 0, F.col("w")).otherwise(F.concat(F.slice("w", F.lit(1), F.greatest(F.col("cut"), F.lit(0))), F.slice("w", F.col("cut") + 2, F.size("w"))))
    spelled = met.join(words.select("h", "w", "by_word"), "h").select("h", "by_word", "way", F.when(F.col("way") == "at", F.col("cut")).otherwise(-1).alias("at"), F.sha2(F.concat_ws(" ", left), 256).alias("left"), (F.col("cut") < 0).alias("whole"))
    spelled = written(spelled.join(open_.drop("s0", "s1", "s2", "s3"), "h").withColumn("place", place), "lines-spelled")
    group = ["by_word", "way", "at", "left"]
    best = spelled.groupBy(*group).agg(F.min("place").alias("any"), F.min(F.when(F.col("whole"), F.col("place"))).alias("shorter"), F.min(F.when(~F.col("whole"), F.col("place"))).alias("longer"))
    judged = spelled.join(best, group)
    earlier = F.when(F.col("way") == "at", F.col("any")).when(F.col("whole"), F.col("longer")).otherwise(F.col("shorter"))
    near = written(judged.where(earlier < F.col("place")).select("h").distinct(), "lines-near")
    marked = row.select("h", "place").join(first.select("h", "first"), "h").join(near.withColumn("near", F.lit(True)), "h", "left")
    reason = F.when(F.col("place") > F.col("first"), "exact").when(F.col("near"), "near")
    return marked.withColumn("reason", reason).where("reason is not null").select("place.rk", "place.doc_id", "place.line_no", "reason")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, rk, n_lines, n_exact, n_near, dropped``.

    ``dropped`` lists the numbers of the dropped lines, from 0, comma-joined in order.  Lines without
    words are never dropped; others if an earlier line equals them or lies within the edit
    bound.  Null is an empty text, one empty line.  Rows equal in id and text are one document, whose
    lines are not copies of each other.  Lines of any length are compared whole.  Other columns are
    ignored; an empty table gives no rows.
    """
    gone = decisions(docs, id_col, text_col, min_words).distinct()
    by_doc = gone.groupBy("rk").agg(
        F.count_if(F.col("reason") == "exact").alias("n_exact"),
        F.count_if(F.col("reason") == "near").alias("n_near"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("line_no")), lambda x: x.cast("string"))).alias("dropped"),
    )
    by_doc = written(by_doc, "lines-dropped")
    breaks = F.octet_length(F.col(text_col)) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
    n_lines = (F.coalesce(breaks, F.lit(0)) + 1).cast("long")
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rk"), n_lines.alias("n_lines"))
    zero = F.lit(0).cast("long")
    return base.join(by_doc, "rk", "left").select("doc_id", "rk", "n_lines", F.coalesce("n_exact", zero).alias("n_exact"), F.coalesce("n_near", zero).alias("n_near"), F.coalesce("dropped", F.lit("")).alias("dropped"))


def without_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all their columns, the text without its dropped lines; null stays null."""
    found = line_dedup(docs, id_col, text_col).where("dropped <> ''").select("rk", "dropped").distinct()
    joined = docs.join(found, F.xxhash64(F.col(id_col), F.col(text_col)) == found["rk"], "left")
    gone = F.split(found["dropped"], ",")
    kept = F.filter(F.split(docs[text_col], "\n"), lambda x, i: ~F.array_contains(gone, i.cast("string")))
    text = F.when(found["dropped"].isNull(), docs[text_col]).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
