"""Text functions over columns: normalising, classifying and reading search queries, and cleaning log lines.

All are built-in expressions, so they stay inside generated code.  Null counts as the empty text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_query(q: Column) -> Column:
    """Lower case; letters, digits, underscores and hyphens in words one space apart."""
    return _squeezed(F.regexp_replace(F.lower(_text(q)), r"(?U)[^\w\s-]", " "))


def normalize_value(v: Column) -> Column:
    """A filter value: lower case, words one space apart."""
    return _squeezed(F.lower(_text(v)))


def tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(r"(?U)([^\W_]+)"), 1)


def mentions(normalized: Column, words: Iterable[str]) -> Column:
    """Whether any of the words or phrases stands in the text as whole words."""
    any_of = "|".join(r"\s+".join(re.escape(p) for p in w.split()) for w in words)
    return normalized.rlike(rf"(?U)(?<!\w)(?:{any_of})(?!\w)")


def labels(q: Column, lexicon_: Mapping[str, Iterable[str]], default: str | None = None) -> Column:
    """The labels whose words the query has, in the lexicon's order; ``default`` alone where there is none."""
    n = normalize_query(q)
    found = F.array_compact(F.array(*[F.when(mentions(n, words), F.lit(name)) for name, words in lexicon_.items()]))
    return found if default is None else F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def brands(q: Column) -> Column:
    return labels(q, lexicon.BRANDS)


def locations(q: Column) -> Column:
    return labels(q, {place.title(): [place] for place in lexicon.LOCATIONS})


def duration(q: Column) -> Column:
    """The shortest rental period named, or whether renting is mentioned at all."""
    n, out = normalize_query(q), None
    for name, words in lexicon.DURATIONS.items():
        out = F.when(mentions(n, words), name) if out is None else out.when(mentions(n, words), name)
    return out.when(mentions(n, ["rent"]), "Rent (unspecified)").otherwise("Not specified")


def gibberish_reason(q: Column) -> Column:
    """Why a query is gibberish: ``known``, ``short``, ``stutter``, ``signs`` or ``poor``; null where it is not."""
    n, raw = normalize_query(q), F.trim(_text(q))
    readable = F.regexp_count(raw, F.lit(r"(?U)[\p{L}\p{N}\s]"))
    letters = F.array_distinct(F.split(F.replace(n, F.lit(" "), F.lit("")), ""))
    reason = F.when(n.isin(lexicon.GIBBERISH), "known").when(F.length(n) < 3, "short").when(n.rlike(r"(.)\1{5}"), "stutter")
    reason = reason.when((F.length(raw) > 5) & (readable < F.length(raw) / 2), "signs")
    return reason.when((F.length(n) > 100) & (F.size(letters) < 10), "poor")


def is_gibberish(q: Column) -> Column:
    """Too short, one character six times running, mostly signs, a known string, or long with few characters."""
    return gibberish_reason(q).isNotNull()


def has_typo(q: Column) -> Column:
    return mentions(normalize_query(q), lexicon.TYPOS)


def is_service(q: Column) -> Column:
    return mentions(normalize_query(q), lexicon.SERVICES)


def is_business(q: Column) -> Column:
    return mentions(normalize_query(q), lexicon.BUSINESS)


def is_route(q: Column) -> Column:
    n = normalize_query(q)
    return F.concat(F.lit(" "), n, F.lit(" ")).contains(" to ") & mentions(n, lexicon.LOCATIONS)


def language(q: Column) -> Column:
    """By script, then by transliterated words."""
    t = _text(q)
    known = mentions(normalize_query(q), lexicon.TRANSLITERATED)
    return F.when(t.rlike("[\\u0B80-\\u0BFF]"), "Tamil").when(t.rlike("[\\u0900-\\u097F]"), "Hindi").when(known, "Transliterated Tamil").otherwise("English")


#: An amount as one word of a query, with or without its currency.
AMOUNT = r"^(?:rs\.?|inr|₹)?([0-9]+(?:\.[0-9]+)?)$"
# What an amount follows as the upper or lower bound of a price, and the two words around a pair of bounds.
UPPER = ["under", "below", "less than", "not more than", "up to", "within", "withing", "budget", "budget of", "maximum", "max"]
LOWER = ["over", "above", "more than", "at least", "minimum", "min"]
PAIRS = {"between": "and", "from": "to"}


def price_bounds(q: Column) -> tuple[Column, Column]:
    """The lowest and highest price a query asks for; null where it names none.

    The query is read word by word: a pair's two amounts with the right words around them, else the first
    amount that follows the words of a bound, else an amount before "range" as the upper bound.
    """
    plain = F.regexp_replace(F.replace(F.lower(_text(q)), F.lit(","), F.lit("")), r"(rs\.?|inr|₹)\s+(?=[0-9])", "")
    words = F.filter(F.split(F.trim(plain), r"\s+"), lambda w: w != "")
    amount = lambda w: F.nullif(F.regexp_extract(w, AMOUNT, 1), F.lit("")).cast("double")
    at = lambda i, k: F.coalesce(F.get(words, i + k), F.lit(""))

    def after(phrase: str, i: Column) -> Column:
        parts = phrase.split()
        return reduce(lambda p, c: p & c, [at(i, k - len(parts)) == w for k, w in enumerate(parts)])

    def first(holds) -> Column:
        """The first amount at whose place the condition holds."""
        found = F.filter(F.transform(words, lambda w, i: F.when(holds(i), amount(w))), lambda v: v.isNotNull())
        return F.get(found, F.lit(0))

    either = lambda phrases, i: reduce(lambda p, c: p | c, [after(p, i) for p in phrases])
    pair = lambda i: reduce(lambda p, c: p | c, [(at(i, -1) == a) & (at(i, 1) == b) & amount(at(i, 2)).isNotNull() for a, b in PAIRS.items()])
    one, two = first(pair), first(lambda i: pair(i - 2))
    ranged = first(lambda i: (at(i, 1) == "range") | ((at(i, 1) == "price") & (at(i, 2) == "range")))
    least = F.when(one.isNotNull(), F.least(one, two)).otherwise(first(lambda i: either(LOWER, i)))
    most = F.when(one.isNotNull(), F.greatest(one, two)).otherwise(F.coalesce(first(lambda i: either(UPPER, i)), ranged))
    return least, most


def operation_group(operation: Column) -> Column:
    o = F.lower(_text(operation))
    planning = o.isin("query_planning", "planning", "llm", "chat", "generation")
    return F.when(planning, "llm").when(o.startswith("rerank"), "reranker").when(o.startswith("embedding"), "embedding").otherwise("other")


# Names whose values are secret, and what replaces them.
SECRET_NAMES = ["x-api-key", "x-admin-key", "api_key", "api-key", "apikey", "password", "passwd", "token", "secret", "key"]
HIDDEN, CUT = "[REDACTED]", "...[truncated]"


def redacted(message: Column, longest: int = 2000) -> Column:
    """A log line without line breaks, controls and secrets, cut to a length.

    Secret are the password of an address, a bearer token, and what is assigned to an authorization
    header or one of ``SECRET_NAMES``, quoted or up to the next space, comma or semicolon.
    """
    quoted, bare = [f"{mark}[^{mark}]*{mark}" for mark in "\"'"], r"[^\s,;]+"
    assigned = "(?:" + "|".join([*quoted, bare]) + ")"
    names = "|".join(map(re.escape, SECRET_NAMES))
    secrets = [  # what stays before, what is hidden, what stays after
        (r"\b[a-z][a-z0-9+.-]*://[^:/\s]+:", r"[^@\s]+", "@"),
        (r"\bauthorization\b\s*[:=]\s*", rf"(?:bearer\s+)?{assigned}", ""),
        (rf"\b(?:{names})\b\s*[:=]\s*", assigned, ""),
        (r"\bbearer\s+", bare, ""),
    ]
    line = F.regexp_replace(F.regexp_replace(_text(message), r"[\r\n]", " "), r"[\p{Cntrl}&&[^\t]]", "")
    for before, hidden, after in secrets:
        line = F.regexp_replace(line, f"(?i)({before}){hidden}({after})", f"$1{HIDDEN}$2")
    return F.when(F.length(line) <= longest, line).otherwise(F.concat(F.left(line, F.lit(longest)), F.lit(CUT)))


def like_escaped(term: str) -> str:
    """A literal term for a LIKE pattern with backslash as escape."""
    return re.sub(r"([\\%_])", r"\\\1", term)


def contains_any(q: Column, parts: Iterable[str]) -> Column:
    """Whether any of the strings stands anywhere in the text, within words too."""
    return F.lower(_text(q)).rlike("|".join(map(re.escape, parts)))


def first_kind(q: Column, kinds: Mapping[str, Iterable[str]], default: str | None = None) -> Column:
    """The first kind any of whose strings the text contains."""
    out = F
    for name, parts in kinds.items():
        out = out.when(contains_any(q, parts), name)
    return out.otherwise(F.lit(default))


def terms(q: Column) -> Column:
    """Words of three Latin letters or more that are no stop words, in order."""
    found = F.regexp_extract_all(F.lower(_text(q)), F.lit("([a-z]+)"), 1)
    return F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(lexicon.STOP_WORDS))
