"""Query planning in bulk: order, budget and intent as columns; catalogue values as canonical filters."""

from __future__ import annotations

from collections.abc import Mapping
from difflib import SequenceMatcher

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions import phrases, text
from tesserae.functions.text import normalize_value

#: How much better the best fuzzy match must be than the next.
MARGIN = 0.04


def sort_order(q: Column) -> Column:
    """``price_asc`` or ``price_desc`` where a query orders by price, else null."""
    n = normalize_value(q)
    return F.coalesce(*[F.when(phrases.said(n, sequences), F.lit(name)) for name, sequences in phrases.ORDERS])


def budget(q: Column, least: float = 10.0, years: tuple[int, int] = (1900, 2100)) -> Column:
    """The only amount that stands alone in a query, unless it is small, a year, or the query names a measure."""
    alone = F.filter(F.split(normalize_value(F.replace(q, F.lit(","), F.lit(""))), " "), lambda w: w.rlike(text.AMOUNT))
    amount = F.regexp_extract(F.get(alone, F.lit(0)), text.AMOUNT, 1).cast("double")
    plain = (F.size(alone) == 1) & ~phrases.said(normalize_value(q), ["measure"])
    return F.when(plain & (amount >= least) & ~amount.between(*years), amount)


def ad_intent(q: Column) -> tuple[Column, Column]:
    """Whether a query looks for ``wanted`` or ``offer`` listings, and whether that is decisive."""
    n = normalize_value(q)
    words = F.split(n, " ")
    closing = F.element_at(words, -1).isin(*phrases.CLASSES["wanted"], *phrases.CLASSES["request"]) & ~F.arrays_overlap(words, F.array(*[F.lit(w) for w in ("i", "we", "you")]))
    opening = (F.get(words, F.lit(0)) == "wanted") & ~(F.coalesce(F.get(words, F.lit(1)), F.lit("")) == "to")
    wanted = closing | opening | phrases.said(n, phrases.WANTED)
    decisive = wanted | phrases.said(n, phrases.OFFER) | ~phrases.said(n, phrases.SIGNALS)
    return F.when(wanted, "wanted").otherwise("offer"), decisive


def canonical(value: str, values: Mapping[str, str], threshold: float | None = None) -> str | None:
    """The catalogue's form of a value: exact, else the one clearly closest of at least ``threshold``; a catalogue is a dimension's names."""
    asked = " ".join(value.lower().split())
    if asked in values or threshold is None or len(asked) < 4:
        return values.get(asked)
    near = sorted(((SequenceMatcher(None, asked, v).ratio(), v) for v in values), reverse=True)[:2]
    if not near or near[0][0] < threshold or (len(near) > 1 and near[0][0] - near[1][0] < MARGIN):
        return None
    return values[near[0][1]]


def resolve(filters: Mapping[str, str | None], catalogue: Mapping[str, Mapping[str, str]], thresholds: Mapping[str, float] | None = None) -> tuple[dict, dict]:
    """Requested filters as the catalogue spells them, and those it does not know."""
    known, unknown = {}, {}
    for name, value in filters.items():
        if value is None or name not in catalogue:
            continue
        found = canonical(value, catalogue[name], (thresholds or {}).get(name))
        (unknown if found is None else known)[name] = value if found is None else found
    return known, unknown
