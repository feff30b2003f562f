"""Quality rules with a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte 4-grams: one of trusted texts, one of the whole raw corpus.  A
text's score is the mean over its n-grams of the log of their ratio, so length does not matter.
Texts below a fixed threshold fail, every text by the same rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import written
from .textstats import counts, per_row

BUCKETS = 1 << 16
N = 4
#: Ids of trusted texts that one pass over the texts sends to every executor; more take more passes.
MOST_IDS = 4_000_000
SMOOTHING = 0.5
#: Of trusted texts, the share that the threshold may fail.
TRUSTED_LOSS = 0.001


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the n-gram from each byte on, and whether it lies within one row."""
    n = len(data) - N + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, bool)
    g = np.zeros(n, np.uint64)
    for j in range(N):
        g |= data[j : j + n].astype(np.uint64) << K.U64(8 * j)
    inside = np.ones(len(data) + N, bool)
    for j in range(1, N):
        inside[np.maximum(offsets[1:] - j, 0)] = False
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a < N:
            inside[a:b] = False
    return ((g * K.U64(0x9E3779B97F4A7C15)) >> K.U64(48)).astype(np.int64), inside[:n]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, data, offsets in K.blocks(batch.column(0)):
            g, inside = _grams(data, offsets)
            total += np.bincount(g[inside], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def multinomial(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of the hashed n-grams of all texts: a fixed number of buckets, whatever the corpus."""
    rows = docs.select(text_col).mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def log_ratio(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    p, q = trusted + SMOOTHING, raw + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def _scores(data: np.ndarray, offsets: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    g, inside = _grams(data, offsets)
    flat = np.zeros(len(data) + 1)
    flat[1 : len(g) + 1] = np.where(inside, ratio[g], 0.0) if len(g) else 0.0
    sums = np.cumsum(flat)
    n = np.zeros(len(data), bool)
    n[: len(g)] = inside
    return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(per_row(n, offsets), 1)


def _texts_of(texts: DataFrame, known: DataFrame) -> DataFrame:
    """The texts of all known ids.  Texts stay where they lie: ids are sent to them, in blocks of a bounded size."""
    blocks = max(1, -(-known.count() // MOST_IDS))
    parts = [texts.join(F.broadcast(known.where(F.pmod(F.xxhash64("labelled"), F.lit(blocks)) == i)), "labelled", "left_semi").select("txt") for i in range(blocks)]
    return reduce(DataFrame.union, parts)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the base counts, ``base_failed``, ``llr``, ``kept``.

    Base counts: n_words, word_chars (code points in words), n_symbols (of ``#*$%&|<>``), n_dup_lines
    (lines with a word that equal an earlier line), n_repeat_words (words in five-word windows found
    twice or more).  ``base_failed``: under 10 words, or over 20% repeated words.  ``kept``: not failed
    and ``llr`` at least the threshold, a low quantile of the trusted texts' own scores.  Trusted are all
    texts whose id has a label of 1; null ids and labels are ignored, of an id's labels the largest counts.  Null is an
    empty text, with counts and llr 0.  Without trusted texts the ratio is 0 and only the base rules
    decide.  Rows that repeat an id are judged each alone; other columns are ignored.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("labelled")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    known = written(known.where("label = 1").select("labelled"), "quality-trusted")
    trusted = _texts_of(docs.select(F.col(id_col).alias("labelled"), F.col(text_col).alias("txt")), known)
    target = multinomial(trusted, "txt")
    ratio = log_ratio(target, multinomial(docs, text_col)) if target.any() else np.zeros(BUCKETS)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in K.blocks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(_scores(data, offsets, ratio))], names=["llr"])

    threshold = 0.0
    if target.any():
        own = written(trusted.mapInArrow(scored, "llr double"), "quality-own")
        n, spread = own.agg(F.count("*"), F.stddev_pop("llr")).first()
        low = own.orderBy("llr").limit(int(n * TRUSTED_LOSS) + 1).agg(F.max("llr")).first()[0]
        threshold = round(low - 0.1 * spread, 12)  # sums of tasks that come in another order give the same

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.blocks(batch.column(1)):
                c = counts(data, offsets)
                llr = _scores(data, offsets, ratio)
                failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
                names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], *(pa.array(c[n], pa.int64()) for n in names), pa.array(failed), pa.array(llr), pa.array(~failed & (llr >= threshold))],
                    names=["doc_id", *names, "base_failed", "llr", "kept"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean")
