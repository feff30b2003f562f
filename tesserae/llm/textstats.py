"""Per-text counts that the quality operators share, from the byte kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import written

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_HEAD = np.arange(256) & 0xC0 != 0x80  # first bytes of code points


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _duplicates(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of (row, hash) pairs: how often each occurs, beside each."""
    key = h ^ K.mix(rows.astype(np.uint64) + K.U64(1))
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    return counts[inverse]


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_distinct of each row."""
    n_rows = len(offsets) - 1
    words = K.Words(data, offsets)
    h = K.word_hashes(data, words)
    out = {"n_words": words.counts.astype(np.int64), "word_chars": per_row(_HEAD[data] & ~K.SPACE[data], offsets), "n_symbols": per_row(SYMBOL[data], offsets)}
    s, at = K.shingle_hashes(h, words, 5)
    cover = np.zeros(len(h) + 6, np.int64)
    if len(s):
        twice = at[_duplicates(s, words.rows[at]) > 1]
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + 5, -1)
    covered = np.cumsum(cover)[: len(h)] > 0
    out["n_repeat_words"] = np.bincount(words.rows[covered], minlength=n_rows).astype(np.int64)
    if len(h):
        first = np.unique(h ^ K.mix(words.rows.astype(np.uint64) + K.U64(1)), return_index=True)[1]
        out["n_distinct"] = np.bincount(words.rows[first], minlength=n_rows).astype(np.int64)
    else:
        out["n_distinct"] = np.zeros(n_rows, np.int64)
    # lines: from a row's start or a newline to the next newline or the row's end
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    starts = starts[starts < len(data)]
    row = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.minimum(offsets[row + 1], np.r_[breaks, len(data)][np.searchsorted(breaks, starts)]) if len(starts) else starts
    ink = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~K.SPACE[data], out=ink[1:])
    inked = ink[ends] > ink[starts]
    starts, ends, row = starts[inked], ends[inked], row[inked]
    out["n_lines"] = np.bincount(row, minlength=n_rows).astype(np.int64)
    if len(starts):
        up, down = K._Powers.get(len(data) + 1)
        sums = np.zeros(len(data) + 1, K.U64)
        np.cumsum((data.astype(K.U64) + K.U64(1)) * up[: len(data)], out=sums[1:])
        lh = K.mix(((sums[ends] - sums[starts]) * down[starts]) ^ ((ends - starts).astype(K.U64) * K.U64(0x2545F4914F6CDD1D)))
        first = np.unique(lh ^ K.mix(row.astype(np.uint64) + K.U64(1)), return_index=True)[1]
        out["n_dup_lines"] = out["n_lines"] - np.bincount(row[first], minlength=n_rows)
    else:
        out["n_dup_lines"] = np.zeros(n_rows, np.int64)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, rows: int, keep=None) -> DataFrame:
    """Texts with their label, ``(txt, label)``, of at most ``rows`` labelled ids: those with the smallest hash.

    Null ids and labels are ignored; of an id's labels the largest counts.  Only ids and labels, of
    that bounded number, are sent to the executors.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("labelled")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    if keep is not None:
        known = known.where(keep(F.col("labelled")))
    known = written(known.orderBy(F.xxhash64("labelled"), "labelled").limit(rows), "labelled-ids")
    texts = docs.select(F.col(id_col).alias("labelled"), F.col(text_col).alias("txt"))
    return written(texts.join(F.broadcast(known), "labelled").select("txt", "label"), "labelled-texts")
