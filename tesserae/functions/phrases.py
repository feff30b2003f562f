"""A small grammar of phrases: classes of words, and sequences of classes, compiled to one pattern each.

A sequence is written as class names: ``"people gap* need"``.  A name is a word of that class, ``name?``
an optional one, ``name*`` up to four (fillers up to three); ``^`` and ``$`` stand for the ends of the text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column

# Words of each class.
CLASSES: dict[str, list[str]] = {
    # prices and order
    "price": ["price", "prices", "rate", "rates", "rent", "fee", "fees", "rental price", "rental rate", "rental fee"],
    "low": ["low", "lowest"],
    "high": ["high", "highest"],
    "to": ["to"],
    "from": ["from"],
    "rising": ["asc", "ascending"],
    "falling": ["desc", "descending"],
    "least": ["low", "lowest", "minimum", "min"],
    "most": ["high", "highest", "maximum", "max"],
    "cost": ["cost", "costs"],
    "rising code": ["l2h", "low2high", "low 2 high", "lo to hi"],
    "falling code": ["h2l", "high2low", "high 2 low", "hi to lo"],
    "cheap": [
        "cheap", "cheapest", "lower", "lowest", "lower priced", "lowest priced", "low priced", "least expensive", "affordable", "economical",
        "inexpensive", "bargain", "bargain priced", "budget friendly", "pocket friendly", "reasonable priced", "reasonably priced", "low cost",
    ],
    "dear": ["most expensive", "higher", "highest", "higher priced", "highest priced", "high priced", "costliest", "dearest", "priciest", "top priced"],
    # who wants and who has
    "people": ["people", "person", "persons", "someone", "somebody", "anyone", "buyer", "buyers", "renter", "renters", "customer", "customers", "client", "clients", "user", "users", "business", "businesses", "companies"],
    "customers": ["buyer", "buyers", "renter", "renters", "customer", "customers", "client", "clients"],
    "suppliers": ["supplier", "suppliers", "provider", "providers", "owner", "owners", "vendor", "vendors", "seller", "sellers", "landlord", "landlords", "freelancer", "freelancers"],
    "needs": ["need", "needs", "needed", "needing", "want", "wants", "wanted", "wanting", "require", "requires", "required", "requiring", "seek", "seeks", "seeking"],
    "searching": ["looking", "searching"],
    "interested": ["interested"],
    "for": ["for"],
    "in": ["in"],
    "self": ["i", "we"],
    "wanted": ["wanted"],
    "request": ["request", "requests", "requirement", "requirements"],
    "listing": ["ad", "ads", "listing", "listings"],
    "find": ["find", "show", "list", "locate"],
    "ask": ["need", "want", "require", "seek", "looking for", "searching for", "find me", "show me", "get me"],
    "me": ["me"],
    "potential": ["potential"],
    "who": ["who"],
    "helping": ["currently", "already", "can", "could", "want to", "need to", "am", "are"],
    "having": ["have", "own", "offer", "provide", "supply", "rent out", "renting out", "lease out", "leasing out"],
    "letting": ["rent out", "lease out"],
    "work": ["work", "job", "jobs", "buyer", "buyers", "renter", "renters", "customer", "customers", "client", "clients", "lead", "leads"],
    "offered": ["offer", "offered", "available"],
    "could": ["do you", "can you", "could you"],
    "serve": ["have", "find", "show", "provide"],
    "let": ["for rent", "for hire", "available for rent", "available for hire"],
    "interest": ["interested", "have", "own", "offer", "provide", "supply"],
    # what a number beside it is no budget for
    "measure": ["cc", "bhp", "hp", "km", "kms", "kilometer", "kilometers", "model", "seater", "year"],
}

# Sequences of each meaning.  Of the orders, those said as a range come first, then codes, then single words.
ORDERS = [
    ("price_asc", ["price from? low to high", "low to high price"]),
    ("price_desc", ["price from? high to low", "high to low price"]),
    ("price_asc", ["rising code"]),
    ("price_desc", ["falling code"]),
    ("price_asc", ["cheap", "least price", "low cost", "rising price", "price rising"]),
    ("price_desc", ["dear", "most price", "falling price", "price falling"]),
]
NEED = ["needs", "searching for", "interested in"]
WANTED = [
    "wanted listing", "listing wanted", "^ request", "request listing", *[f"people gap* {n}" for n in NEED], "find me? potential? customers", "find me? request",
    "find me? wanted listing", "searching for customers", "searching for people", "who needs", "self helping* having", "letting", "suppliers gap* searching for work",
]
OFFER = ["offered listing", "listing offered", *[f"self gap* {n}" for n in NEED], "^ ask", "could serve", "let"]
SIGNALS = ["wanted", "request", "needs", "searching", "interest", "customers", "suppliers"]

_GAP = r"[a-z0-9'-]+"


def _class(name: str) -> str:
    if name == "gap":
        return _GAP
    words = sorted(CLASSES[name], key=len, reverse=True)
    return "(?:" + "|".join(r"[\s-]+".join(map(re.escape, w.split())) for w in words) + ")"


def _names(sequence: str) -> list[str]:
    """The parts of a sequence; the two names of two words are read whole."""
    whole = {"rising code", "falling code"}
    return [sequence] if sequence in whole else sequence.split()


def compiled(sequence: str) -> str:
    """The pattern of one sequence: its words in order, apart by white space, as whole words."""
    out, first = "", True
    for part in _names(sequence):
        if part == "^":
            out += r"^\s*"
            continue
        name, mark = (part[:-1], part[-1]) if part[-1] in "?*" else (part, "")
        word = _class(name)
        if mark:
            times = "?" if mark == "?" else "{0,4}" if name == "gap" else "{0,3}"
            out += rf"(?:\s+{word}){times}"
        else:
            out += word if first else rf"\s+{word}"
        first = False
    return rf"(?<!\w){out}(?!\w)"


def said(text: Column, sequences: list[str]) -> Column:
    """Whether lower-cased text has one of the sequences."""
    return text.rlike("(?U)" + "|".join(compiled(s) for s in sequences))
