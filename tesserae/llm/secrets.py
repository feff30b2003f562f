"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings, in column expressions only.

Nothing is shuffled: a text's spans come from that text alone.  The cost of a text is linear in its
length, whatever it holds: no pattern nests repeats, and running values are kept in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the three base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
ENTROPY = len(KINDS) - 1

#: Candidates for the entropy scan: all runs of so many characters of the widest class.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least bits per character of a window by the class of its characters; the first class that fits counts.
CLASS_BITS = (
    ("digits", r"^[0-9+/_=-]+$", 99.0),
    ("hexadecimal", r"^([0-9a-f]+|[0-9A-F]+)$", 3.0),
    ("letters of one case", r"^([a-z+/_=-]+|[A-Z+/_=-]+)$", 4.2),
    ("letters", r"^[A-Za-z+/_=-]+$", 3.95),
    ("letters of one case and digits", r"^([a-z0-9+/_=-]+|[A-Z0-9+/_=-]+)$", 3.7),
    ("all", r"^", 3.8),
)
LEAST_BITS = min(bits for _, _, bits in CLASS_BITS)
# The allow-list: what looks random and is no secret is cut out of a candidate before windows slide over the rest.
UUID = r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
SEPARATOR = r"([/_=-])"
#: Segments between separators: words shorter than a window, numbers, and placeholders.
SEGMENTS = r"[A-Z]?[a-z]{1,19}|[A-Z]{1,19}|[0-9]+|[A-Za-z0-9+]*(?i:example|sample|dummy|placeholder|changeme)[A-Za-z0-9+]*"
#: Characters that one fold goes over; running values are copied only within so many.
FOLD, BLOCK = 4000, 512

_SPANS = "array<struct<start:int,kind:int,end:int>>"
#: What a count's last one adds to the sum of c * log2(c).
_STEPS = [0.0, 0.0, *(c * math.log2(c) - (c - 1) * math.log2(c - 1) for c in range(2, WINDOW + 2))]


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, first: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The running values of an associative ``op`` over an array that is not empty, in blocks: a growing array is copied at each step."""
    last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))

    def along(a: Column, start: Column) -> Column:
        return F.aggregate(a, F.array(start), lambda s, v: F.array_append(s, op(F.element_at(s, -1), v)))

    starts = along(F.transform(blocks, lambda b: F.aggregate(b, first, op)), first)
    return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), last + 1), lambda b, s: F.slice(along(b, s), F.lit(2), F.size(b))))


def _steps(text: Column, found: Column, pattern: str) -> Column:
    """How far it is from each match's end to the next match's, in code points."""
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.char_length)
    return F.when(F.size(found) > 0, F.zip_with(gaps, found, lambda g, s: g + F.char_length(s)))


def _spans(steps: str, found: str, kind: int) -> Column:
    """(start, kind, end) of all matches; ``steps`` and ``found`` are columns, which the running sum reads again and again."""
    ends = _running(F.col(steps), F.lit(0), lambda a, b: a + b)
    spans = F.zip_with(ends, F.col(found), lambda e, s: F.struct((e - F.char_length(s)).alias("start"), F.lit(kind).alias("kind"), e.alias("end")))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(_SPANS))


def _best_window(s: Column, value: Callable[[Column, Column], Column]) -> Column:
    """The largest ``value(window, bits)`` of all windows of an ASCII string; null if it is shorter than one.

    The sum of c * log2(c) over the counts of a window's characters is kept from step to step: only
    the counts of the character that enters and of the one that leaves change it.
    """
    steps = F.lit(_STEPS)
    count = lambda w, x: F.length(w) - F.length(F.replace(w, x, F.lit("")))
    start = F.struct(F.lit("").alias("w"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("best"))

    def move(a: Column, x: Column) -> Column:
        def entered(wide: Column) -> Column:
            full = F.length(wide) > WINDOW
            gain = F.get(steps, count(wide, x))
            loss = F.get(steps, count(wide, F.left(wide, F.lit(1))))
            w = F.when(full, F.substring(wide, 2, WINDOW)).otherwise(wide)
            return F.struct(w.alias("w"), (a["sum"] + F.when(full, gain - loss).otherwise(gain)).alias("sum"))

        def judged(now: Column) -> Column:
            best = F.when(F.length(now["w"]) == WINDOW, F.greatest(a["best"], value(now["w"], F.lit(math.log2(WINDOW)) - now["sum"] / WINDOW))).otherwise(a["best"])
            return F.struct(now["w"].alias("w"), now["sum"].alias("sum"), best.alias("best"))

        return _with(_with(F.concat(a["w"], x), entered), judged)

    return F.aggregate(F.slice(F.split(s, ""), F.lit(1), F.length(s)), start, move)["best"]


def peak_entropy(s: Column) -> Column:
    """The most bits per character of any window of 20 characters of an ASCII string."""
    return _best_window(s, lambda w, bits: bits)


def _margin(w: Column, bits: Column) -> Column:
    """Bits above what the class of the window's characters must have."""
    least = F
    for _, pattern, needed in CLASS_BITS:
        least = least.when(w.rlike(pattern), F.lit(needed))
    return bits - F.when(bits < LEAST_BITS, F.lit(99.0)).otherwise(least)


def _suspicious(run: Column) -> Column:
    """Whether some window of the run, without its allowed parts, has enough entropy for its class."""
    marked = F.concat(F.lit("\x01"), F.regexp_replace(F.regexp_replace(run, UUID, " "), SEPARATOR, "\x01$1\x01"), F.lit("\x01"))
    rest = F.replace(F.regexp_replace(marked, f"\x01({SEGMENTS})\x01", " "), F.lit("\x01"), F.lit(""))
    pieces = F.filter(F.transform(F.split(rest, " "), lambda p: F.regexp_replace(p, r"^[/_=-]+|[/_=-]+$", "")), lambda p: F.length(p) >= WINDOW)
    # blocks that overlap by a window less one character, so that a long run needs no long fold
    cut, over = rf"(?s)(.{{1,{FOLD}}})(?=(.{{0,{WINDOW - 1}}}))", lambda p, g: F.regexp_extract_all(p, F.lit(cut), F.lit(g))
    cut_up = lambda p: F.zip_with(over(p, 1), over(p, 2), lambda a, b: F.concat(a, b))
    return F.exists(pieces, lambda p: F.exists(cut_up(p), lambda b: F.coalesce(_best_window(b, _margin) >= 0, F.lit(False))))


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def _apart(t: DataFrame) -> DataFrame:
    """With ``extra``: the spans of ``odd`` that overlap none of ``base``, by two passes over all in order of their starts."""
    is_base = lambda x: x["kind"] < ENTROPY
    never = F.lit(2**31 - 1)
    t = t.withColumn("every", F.when(F.size("odd") > 0, F.array_sort(F.concat("base", "odd"))))
    t = t.withColumn("ends", F.transform("every", lambda x: F.when(is_base(x), x["end"]).otherwise(0)))
    t = t.withColumn("starts", F.reverse(F.transform("every", lambda x: F.when(is_base(x), x["start"]).otherwise(never))))
    t = t.withColumn("before", F.when(F.size("odd") > 0, _running(F.col("ends"), F.lit(0), lambda a, b: F.greatest(a, b))))
    t = t.withColumn("after", F.when(F.size("odd") > 0, F.reverse(_running(F.col("starts"), never, lambda a, b: F.least(a, b)))))
    free = F.filter(F.arrays_zip("every", "before", "after"), lambda m: ~is_base(m["every"]) & (m["before"] <= m["every"]["start"]) & (m["after"] >= m["every"]["end"]))
    return t.withColumn("extra", F.coalesce(F.transform(free, lambda m: m["every"]), F.array().cast(_SPANS)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans``.

    Base kinds are leftmost non-overlapping matches, each kind by itself: assignments whose value has 6
    or more characters, access keys of 20 or more, runs of 24 or more lower-case hexadecimal digits.
    The entropy scan adds runs that no base span overlaps and in which, once UUIDs, words, numbers and
    placeholders between separators are cut out, some window of 20 characters has the bits that its
    character class needs.  A span is ``kind:start:end`` in code points, end exclusive, sorted by
    start, then by kind as listed.  Null is an empty text; empty texts have no spans.  A text of any
    length is read whole.  Other columns are ignored; rows that repeat an id are scanned each alone; an
    empty table gives no rows.
    """
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    patterns = (ASSIGN, ACCESS, HEX, CANDIDATE)
    t = t.select("*", *[F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(f"f{i}") for i, p in enumerate(patterns)])
    values = F.when(F.size("f0") > 0, F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)))
    t = t.select("*", values.alias("values"), *[_steps(F.col("t"), F.col(f"f{i}"), p).alias(f"s{i}") for i, p in enumerate(patterns)])
    t = t.select("doc_id", "values", "f3", *[_spans(f"s{i}", f"f{i}", i).alias(f"x{i}") for i in range(len(patterns))])
    t = t.select(
        "doc_id",
        F.filter("x0", lambda x, i: F.char_length(F.get(F.col("values"), i)) >= 6).alias("assign"),
        F.filter("x1", lambda x: x["end"] - x["start"] >= 20).alias("access"),
        F.col("x2").alias("hex"),
        F.when(F.size("f3") > 0, F.filter("x3", lambda x, i: _suspicious(F.get(F.col("f3"), i)))).otherwise(F.col("x3")).alias("odd"),
    )
    t = _apart(t.withColumn("base", F.concat("assign", "access", "hex")))
    size = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return t.select("doc_id", size("assign"), size("access"), size("hex"), F.size("extra").cast("long").alias("n_entropy"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "extra")).alias("spans"))
