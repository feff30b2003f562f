"""Quality classifier: a sparse rule ensemble.

Small trees are grown on text statistics of labelled texts; every path from a root is a rule, a
conjunction of bounds on statistics.  A lasso-penalised logistic regression weighs the rules; those
of weight 0 are dropped and the rest are compiled into one Spark column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .textstats import counts, labelled_sample, per_row

#: Labelled rows that the trees and weights are fitted on, at most.
SAMPLE_ROWS = 20_000
TREES = 40
DEPTH = 3
LASSO = 1e-3

STATISTICS = ("log_words", "word_length", "symbols", "upper", "digits", "marks", "beyond_ascii", "dup_lines", "repeats", "line_words", "distinct", "pipes", "shouts")


def _mask(chars: str) -> np.ndarray:
    m = np.zeros(256, bool)
    m[[ord(c) for c in chars]] = True
    return m


_UPPER = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _mask("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _mask("0123456789")
_MARK = _mask(".,;:!?'\"()-")
_PIPE = _mask("|")
_SHOUT = _mask("!")
_BEYOND = np.arange(256) >= 0x80


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; an empty text has zeros."""
    c = counts(data, offsets)
    n, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    share = lambda m, of: per_row(m[data], offsets) / np.maximum(of, 1)
    return np.stack(
        [
            np.log1p(c["n_words"]), c["word_chars"] / n, c["n_symbols"] / chars, share(_UPPER, per_row(_LETTER[data], offsets)), share(_DIGIT, chars), share(_MARK, chars), share(_BEYOND, np.diff(offsets)),
            c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / n, np.log1p(c["n_words"] / np.maximum(c["n_lines"], 1)), c["n_distinct"] / n, share(_PIPE, n), share(_SHOUT, n),
        ],
        axis=1,
    )


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, bound), all of which hold


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]


def _grow(x: np.ndarray, y: np.ndarray, bins: list[np.ndarray], rng: np.random.Generator, path: Rule, rows: np.ndarray, out: set[Rule]) -> None:
    """Split on the bound that lowers the squared error most, among half of the statistics."""
    if len(path) == DEPTH or len(rows) < 40 or y[rows].min() == y[rows].max():
        return
    best = (1e-9, None)
    total, n = y[rows].sum(), len(rows)
    for j in rng.permutation(x.shape[1])[: max(1, x.shape[1] // 2)]:
        if not len(bins[j]):
            continue
        place = np.searchsorted(bins[j], x[rows, j], side="left")
        k = len(bins[j]) + 1
        left_n = np.cumsum(np.bincount(place, minlength=k))[:-1]
        left_y = np.cumsum(np.bincount(place, weights=y[rows], minlength=k))[:-1]
        ok = (left_n >= 10) & (n - left_n >= 10)
        gain = np.where(ok, left_y**2 / np.maximum(left_n, 1) + (total - left_y) ** 2 / np.maximum(n - left_n, 1) - total**2 / n, 0)
        if gain.max() > best[0]:
            best = (gain.max(), (int(j), float(bins[j][gain.argmax()])))
    if best[1] is None:
        return
    j, bound = best[1]
    for above in (False, True):
        rule = (*path, (j, above, bound))
        out.add(rule)
        _grow(x, y, bins, rng, rule, rows[(x[rows, j] > bound) == above], out)


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, j] > bound) == above for j, above, bound in rule])


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Model:
    """Rules of ``TREES`` trees on random halves of the rows, weighed by proximal gradient steps."""
    if not len(y) or y.min() == y.max():
        p = min(max(y.mean() if len(y) else 0.5, 0.02), 0.98)
        return Model(float(np.log(p / (1 - p))), (), ())
    rng = np.random.default_rng(seed)
    bins = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 64))) for j in range(x.shape[1])]
    found: set[Rule] = set()
    for _ in range(TREES):
        _grow(x, y.astype(float), bins, rng, (), rng.permutation(len(y))[: max(40, len(y) // 2)], found)
    rules = sorted(found)
    z = np.stack([_holds(r, x) for r in rules], axis=1).astype(np.float32)
    w, b = np.zeros(len(rules), np.float32), float(np.log(y.mean() / (1 - y.mean())))
    v = np.ones(len(rules)) / np.sqrt(len(rules))
    for _ in range(20):  # the largest eigenvalue gives the step
        v = z.T @ (z @ v)
        top = np.linalg.norm(v)
        v /= top
    step = 4 * len(y) / (top + len(y))
    ahead, ahead_b, t = w, b, 1.0
    for _ in range(300):
        err = (1 / (1 + np.exp(-np.clip(z @ ahead + ahead_b, -30, 30))) - y) / len(y)
        new = ahead - step * (z.T @ err)
        new = np.sign(new) * np.maximum(np.abs(new) - step * LASSO, 0)
        new_b = ahead_b - step * float(err.sum())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return Model(b, tuple(rules[i] for i in kept), tuple(float(w[i]) for i in kept))


def compiled(model: Model) -> Column:
    """The score, between 0 and 1, as an expression over the statistics' columns."""
    total = F.lit(model.intercept)
    for rule, weight in zip(model.rules, model.weights, strict=True):
        parts = [(F.col(STATISTICS[j]) > bound) if above else (F.col(STATISTICS[j]) <= bound) for j, above, bound in rule]
        total = total + F.when(reduce(lambda p, q: p & q, parts), F.lit(weight)).otherwise(F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-total))


def _measured(keep: int):
    """Statistics of the texts in the last column, beside the columns before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.blocks(batch.column(keep)):
                x = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(keep)), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], names=[*batch.schema.names[:keep], *STATISTICS])

    return run


_SCHEMA = ", ".join(f"{s} double" for s in STATISTICS)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, keep=None) -> Model:
    """Fit on at most ``sample_rows`` labelled rows for whose id ``keep`` holds."""
    sample = labelled_sample(docs, labels, label_col, id_col, text_col, sample_rows, keep)
    got = sample.select("label", "txt").mapInArrow(_measured(1), f"label int, {_SCHEMA}").toArrow()  # at most ``sample_rows`` rows
    x = np.stack([got.column(s).to_numpy() for s in STATISTICS], axis=1)
    y = got.column("label").to_numpy()
    order = np.lexsort((y, *x.T))  # the same model whatever the order of arrival
    return fit_rules(x[order], y[order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, score, predicted``, with the statistics.

    Null and empty texts have statistics 0 and are scored like any other.  Only the text enters the
    score.  Rows that repeat an id are scored each alone; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(_measured(1), f"doc_id {kind}, {_SCHEMA}")
    rows = rows.withColumn("score", compiled(model))
    return rows.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *STATISTICS)
