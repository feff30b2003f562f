"""Sharding by a Feistel permutation of global row numbers, in DataFrame operations only.

Rows get global numbers 0 to n-1 in a fixed order.  A Feistel network permutes a range of a * b
numbers that is at least n and less than n + a; a number that lands at n or beyond is permuted
again (cycle walking) until it lands inside.  The permuted number p is a reproducible shuffle:
shard p mod m, slot p div m.  Both can be computed for any row number without the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import expanded, written

ROUNDS = 6
#: Walks that one expression allows.  A walk more has odds below 1/sqrt(n), so 64 never run out; if they did, the job fails.
WALKS = 64
_PRIME = 2_147_483_647
#: Rows that one numbering bucket holds.
BUCKET_ROWS = 200_000


def _keys(seed: int) -> list[tuple[int, int, int]]:
    state, out = (seed * 2 + 1) % _PRIME, []
    for _ in range(ROUNDS):
        row = []
        for _ in range(3):
            state = state * 48271 % _PRIME
            row.append(state)
        out.append(tuple(row))
    return out


def _domain(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permuted(x: int, n: int, seed: int = 11) -> int:
    """The permuted number of x in 0..n-1, computed alone."""
    a, b = _domain(n)
    while True:
        left, right = x % a, x // a
        m, other = a, b
        for k1, k2, k3 in _keys(seed):
            t = (right + k1) % _PRIME
            t = t * t % _PRIME
            t = (t * (k2 % 65536) + k3) % _PRIME
            left, right, m, other = right, (left + t) % m, other, m
        x = left + m * right
        if x < n:
            return x


def _network(x: Column, n: int, seed: int, walks: int) -> Column:
    """Up to so many passes of the network over ``x``, as one fold over the rounds; stops changing once inside 0..n-1."""
    a, b = _domain(n)
    keys = _keys(seed)
    k1, k2, k3 = (F.array(*[F.lit(v).cast("long") for v in c]) for c in zip(*[(k[0], k[1] % 65536, k[2]) for k in keys], strict=True))
    m = F.array(*[F.lit(a if j % 2 == 0 else b).cast("long") for j in range(ROUNDS)])

    def turn(s: Column, i: Column) -> Column:
        j = i % ROUNDS
        left = F.when(j == 0, s["x"] % a).otherwise(s["l"])
        right = F.when(j == 0, F.floor(s["x"] / a)).otherwise(s["r"])
        t = (right + F.get(k1, j)) % _PRIME
        t = (t * t) % _PRIME
        t = (t * F.get(k2, j) + F.get(k3, j)) % _PRIME
        new = (left + t) % F.get(m, j)
        x = F.when(j == ROUNDS - 1, right + F.lit(a) * new).otherwise(s["x"])
        go = (j < ROUNDS - 1) | (x >= n)
        return F.when(s["go"], F.struct(x.alias("x"), right.alias("l"), new.alias("r"), go.alias("go"))).otherwise(s)

    zero = F.lit(0).cast("long")
    start = F.struct(x.cast("long").alias("x"), zero.alias("l"), zero.alias("r"), F.lit(True).alias("go"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS * walks - 1)), start, turn)["x"]


def permute(x: Column, n: int, seed: int = 11) -> Column:
    """``permuted`` as a column expression over row numbers of type long."""
    a, b = _domain(n)
    once = _network(x, n, seed, 1)
    walked = _network(once, n, seed, min(WALKS, a * b - n + 1))
    done = F.when(once < n, once).otherwise(walked)
    return F.when(done < n, done).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long"))


def numbered(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """``rows``, which have only ``columns``, with ``number``: 0 to n-1 without gaps, the same on every run.

    Equal rows are counted first and get a run of numbers, so that many of them are one row here.
    Distinct rows are dealt to buckets by a checksum of their columns; a bucket starts where those
    before it end, and rows are numbered within it in the order of the columns (null last).  The number
    of buckets follows n, so a bucket fits a task at any size.
    """
    buckets = max(12, -(-n // BUCKET_ROWS))
    check = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    groups = written(rows.groupBy(*columns).agg(F.count("*").alias("copies")).withColumn("bucket", check % buckets), "shard-groups")
    counts = groups.groupBy("bucket").agg(F.sum("copies").alias("held"))
    offsets = counts.select("bucket", (F.sum("held").over(Window.orderBy("bucket")) - F.col("held")).alias("offset"))
    before = Window.partitionBy("bucket").orderBy(*[F.col(c).asc_nulls_last() for c in columns]).rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("place", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    runs = placed.join(F.broadcast(offsets), "bucket").select(*columns, "copies", (F.col("offset") + F.col("place")).alias("start"))
    return expanded(runs, "copies", "index").select(*columns, (F.col("start") + F.col("index")).alias("number"))


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """Per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, number``.

    The law is ``rows``: shards' counts differ by one at most, slots run from 0 without gaps, and
    ``grown_shard`` is null.  Rows are numbered by a checksum of id, checksum of the text and size and
    then by those values, so equal rows are interchangeable; rows with equal texts or equal or null ids
    are spread like all others, since no group may outweigh a shard.  ``size`` is the text's UTF-8
    bytes (null: none) and 8.  Only these narrow columns move.  Other columns are ignored; an empty
    table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.crc32(text).alias("text_crc32"), (F.octet_length(text) + 8).cast("long").alias("size"))
    narrow = written(narrow, "shard-rows")
    n = narrow.count()
    rows = numbered(narrow, ["doc_id", "text_crc32", "size"], n)
    rows = rows.withColumn("p", permute(F.col("number"), n, seed)) if n else rows.withColumn("p", F.col("number"))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("p") % shards).cast("int").alias("shard"),
        F.floor(F.col("p") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "number",
    )
