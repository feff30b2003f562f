"""Texts and JSON of documents and requests as columns: labelled texts, keys, scalars, cursors and matches."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.text import normalize_value, tokens

#: Characters that a metadata key keeps, at most.
LONGEST_KEY = 120


def metadata_key(name: Column, longest: int = LONGEST_KEY) -> Column:
    """Lower case, runs of other characters than letters and digits one underscore, none at the ends, cut to a length."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(longest))


def labelled(text: Column, labels: Sequence[str]) -> Column:
    """A map from metadata keys to what follows each label, up to the next label; labels without content are left out."""
    names = "|".join(sorted(map(re.escape, labels), key=len, reverse=True))
    lines = F.regexp_replace(text, rf"(?i)\s*\b({names})\s*:", "\n$1:")
    found = F.transform(F.split(lines, "\n"), lambda x: F.struct(metadata_key(F.regexp_extract(x, rf"(?i)^({names}):", 1)).alias("key"), F.trim(F.regexp_replace(x, rf"(?i)^({names}):", "")).alias("value")))
    kept = F.filter(found, lambda x: (x["key"] != "") & (x["value"] != ""))
    first = F.filter(kept, lambda x, i: F.array_position(F.transform(kept, lambda y: y["key"]), x["key"]) == i + 1)
    return F.map_from_entries(first)


def plural_pattern(term: str) -> str:
    """A pattern of a word or phrase in singular and plural, as whole words."""
    words = term.lower().split()
    last = words[-1]
    if re.search("[^aeiou]y$", last):
        end = re.escape(last[:-1]) + "(?:y|ies)"
    elif re.search("(s|x|z|ch|sh)$", last):
        end = re.escape(last) + "(?:es)?"
    else:
        end = re.escape(last) + "s?"
    return r"\b" + r"\s+".join([*map(re.escape, words[:-1]), end]) + r"\b"


def mentions_value(text: Column, value: Column) -> Column:
    """Whether the text contains a value, as it stands or with all but letters and digits left out of both."""
    compact = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return normalize_value(text).contains(normalize_value(value)) | ((compact(value) != "") & compact(text).contains(compact(value)))


def subsequence_of(short: str, text: Column) -> Column:
    """Whether the characters of ``short`` stand in the text in their order, with any others between them."""
    return text.rlike(".*".join(map(re.escape, short)))


def within_typo(a: Column, b: Column) -> Column:
    """At most one edit between names of up to five characters, two between longer ones."""
    bound = F.when(F.greatest(F.length(a), F.length(b)) <= 5, 1).otherwise(2)
    return F.levenshtein(a, b) <= bound


def similarity(a: Column, b: Column) -> Column:
    """1 less edits by the longer length; 1 for two empty texts."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def token_subset(a: Column, b: Column) -> Column:
    """Whether all of a text's tokens are among another's."""
    return F.size(F.array_except(tokens(a), tokens(b))) == 0


def rewritten(text: Column, aliases: Mapping[str, str]) -> Column:
    """The text with each alias, as whole words and longest first, in its canonical form."""
    out = normalize_value(text)
    for alias in sorted(aliases, key=lambda a: (-len(a), a)):
        out = F.regexp_replace(out, rf"\b{re.escape(alias.lower())}\b", aliases[alias].lower())
    return out


def tri_state(value: Column) -> Column:
    """True, false, or null for what says neither."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("true", "1", "yes", "on"), True).when(v.isin("false", "0", "no", "off"), False)


def clean_number(value: Column, default: float = 0.0) -> Column:
    """A finite number, or the default."""
    n = value.try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), F.lit(default)).otherwise(n)


def count(value: Column) -> Column:
    """A whole number of at least 0."""
    return F.greatest(F.floor(clean_number(value)), F.lit(0)).cast("long")


def utc_iso(value: Column) -> Column:
    """A time as ISO text in UTC; what is no time stays as it is."""
    t = F.try_to_timestamp(value)
    return F.coalesce(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"), value)


def is_month(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9]{4}-(0[1-9]|1[0-2])$"), F.lit(False))


def card_value(value: Column) -> Column:
    """A card's value as text: the word NULL is null, whole numbers have no fraction."""
    v = F.nullif(F.trim(value), F.lit("NULL"))
    n = v.try_cast("double")
    return F.when(n.isNotNull() & (n == F.floor(n)), n.cast("long").cast("string")).otherwise(v)


def cursor(*parts: Column) -> Column:
    """The values of a page's last row as one opaque text."""
    return F.base64(F.encode(F.concat_ws("|", *[p.cast("string") for p in parts]), "UTF-8"))


def cursor_parts(code: Column) -> Column:
    return F.split(F.decode(F.unbase64(code), "UTF-8"), r"\|")


def scalars(json: Column, names: Sequence[str], longest: int = 191) -> list[Column]:
    """Allowed scalar fields of a JSON object as texts, blank ones null, cut to a length."""
    return [F.left(F.nullif(F.trim(F.get_json_object(json, f"$.{n}")), F.lit("")), F.lit(longest)).alias(n) for n in names]


def timings(json: Column, stages: Sequence[str], total: Column) -> list[Column]:
    """The milliseconds of fixed stages, three decimals; none below 0 or not finite.  The total is the one given, if any."""
    out = []
    for s in stages:
        n = F.get_json_object(json, f"$.{s}").try_cast("double")
        out.append(F.when((n >= 0) & ~F.isnan(n) & (n < float("inf")), F.round(n, 3)).alias(s))
    return [*out, F.coalesce(F.round(total, 3), F.round(F.get_json_object(json, "$.total").try_cast("double"), 3)).alias("total")]


def log_class(level: Column, status: Column, logger: Column) -> Column:
    """What kind of event a log line is: a failed request, an error, a warning, or plain application log."""
    return F.when(status >= 500, "http_failure").when(F.upper(level).isin("ERROR", "CRITICAL"), "error").when(F.upper(level) == "WARNING", "warning").when(logger.startswith("access"), "request").otherwise("application")


def browse_label(parts: Sequence[Column]) -> Column:
    """What a search without text is called: its filters, or that it browses all."""
    said = F.concat_ws(", ", *[F.nullif(F.trim(p.cast("string")), F.lit("")) for p in parts])
    return F.when(said != "", F.concat(F.lit("Filtered browse: "), said)).otherwise("Catalogue browse")
