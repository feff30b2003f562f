"""Telemetry streams: idempotent delivery, windows, counters and rate limits; the same functions take batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, time_col: str = "created_at", size: str = "5 minutes", late: str = "10 minutes", value: str = "duration_ms") -> DataFrame:
    """Requests and mean latency per window: ``start, requests, avg_ms``; events later than ``late`` are dropped in streams."""
    timed = events.withWatermark(time_col, late) if events.isStreaming else events
    out = timed.groupBy(F.window(time_col, size).alias("w")).agg(F.count("*").alias("requests"), F.avg(value).alias("avg_ms"))
    return out.select(F.col("w.start").alias("start"), "requests", "avg_ms")


def usage_counters(events: DataFrame, keys: list[str], time_col: str = "created_at", sums: tuple[str, ...] = ("total_tokens",)) -> DataFrame:
    """Monthly additive counters by the given keys."""
    month = F.date_format(time_col, "yyyy-MM").alias("month")
    return events.groupBy(month, *keys).agg(F.count("*").alias("requests"), *[F.sum(s).alias(s) for s in sums])


def cleaned(events: DataFrame, limits: dict[str, int], counts: tuple[str, ...] = ()) -> DataFrame:
    """Events as they are stored: whitespace squeezed, texts cut to their limits, counts at least 0."""
    fixed = {c: F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, n) for c, n in limits.items()}
    return events.withColumns(fixed | {c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in counts})


def delivered(events: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str, key: str = "request_id", time_col: str = "created_at", late: str = "1 day") -> StreamingQuery:
    """Deliver each request once: repeats within ``late`` are dropped, and a batch that fails is tried again.

    ``store(rows, batch)`` must give equal results when a batch comes twice, as writing a folder
    named by the batch does.
    """
    once = events.withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])
    return once.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()


def limited(events: DataFrame, per_minute: int, burst: int, scope: str = "scope", time_col: str = "created_at") -> DataFrame:
    """``scope, created_at, allowed, remaining``: a token bucket for each scope, filled by event time.

    Events of a micro-batch are taken in the order of time; an earlier time than the bucket's refills nothing.
    """

    def turn(key: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, at = state.get if state.exists else (float(burst), None)
        rows = pd.concat(list(pages)).sort_values(time_col, kind="stable")
        allowed, remaining = [], []
        for now in rows[time_col].astype("datetime64[us]").astype("int64") / 1e6:
            left = min(float(burst), left + max(0.0, now - (now if at is None else at)) * per_minute / 60)
            at = now if at is None else max(at, now)
            fits = left >= 1
            left -= fits
            allowed.append(bool(fits))
            remaining.append(int(left))
        state.update((left, at))
        yield pd.DataFrame({scope: key[0], time_col: rows[time_col].values, "allowed": allowed, "remaining": remaining})

    kind = events.schema[scope].dataType.simpleString()
    return events.select(scope, time_col).groupBy(scope).applyInPandasWithState(
        turn, f"{scope} {kind}, {time_col} timestamp, allowed boolean, remaining long", "left double, at double", "append", GroupStateTimeout.NoTimeout
    )
