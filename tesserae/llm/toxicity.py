"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features are words and word beginnings that toxic labelled texts have far more often than others.
Grades: 0 for texts labelled clean; toxic ones are graded 1 to 3 by thirds of the share of their
sentences that hold such a feature, a measure the score does not see.  One weight vector serves all thresholds, P(grade <= k) = sigmoid(theta_k - w x);
the output is the expected grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import written

#: Labelled rows that the classifier is fitted on, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
#: Sparse features kept, at most.
FEATURES = 4096
#: Word beginnings of so many bytes are features beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
GRADES = 4

#: Bytes of words here: letters, digits and everything beyond ASCII.
_WORDLIKE = np.ones(256, np.uint8)
_WORDLIKE[:0x30] = _WORDLIKE[0x3A:0x41] = _WORDLIKE[0x5B:0x61] = _WORDLIKE[0x7B:0x80] = 0
_STOPS = np.frombuffer(b".!?\n", np.uint8)
_CLEAN = np.where(_WORDLIKE.astype(bool), K.LOWER, 0x20).astype(np.uint8)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Words per row; then feature hashes, the rows they lie in, and their first bytes, by kind of feature."""
    clean = _CLEAN[data]
    words = K.Words(clean, offsets)
    if not len(words.starts):
        return words.counts, [], [], []
    up, down = K._Powers.get(len(clean) + 1)
    sums = np.zeros(len(clean) + 1, K.U64)
    np.cumsum((clean.astype(K.U64) + K.U64(1)) * up[: len(clean)], out=sums[1:])
    kinds, rows, places = [], [], []
    length = words.ends - words.starts
    for n in (0, *BEGINNINGS):
        at = np.flatnonzero(length > n) if n else slice(None)
        starts = words.starts[at]
        ends = starts + n if n else words.ends
        kinds.append(K.mix(((sums[ends] - sums[starts]) * down[starts]) ^ K.U64(0x51ED270B * (n + 1))))
        rows.append(words.rows[at])
        places.append(starts)
    return words.counts, kinds, rows, places


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: features with the number of toxic and clean texts that have them."""
    for batch in batches:
        toxic = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int64)
        for a, b, data, offsets in K.blocks(batch.column(0)):
            _, kinds, rows, _ = _features(data, offsets)
            if not kinds:
                continue
            h, r = np.concatenate(kinds), np.concatenate(rows)
            order = np.lexsort((r, h))
            h, r = h[order], r[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]
            h, t = h[new], toxic[a:b][r[new]]
            cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            n = np.diff(np.r_[cut, len(h)])
            t = np.add.reduceat(t, cut)
            yield pa.RecordBatch.from_arrays([pa.array(h[cut].view(np.int64)), pa.array(t), pa.array(n - t)], names=["feature", "toxic", "clean"])


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes, their weights, the weights of the dense features, and the thresholds."""

    hashes: np.ndarray
    weights: np.ndarray
    dense: np.ndarray
    thetas: np.ndarray


def _sparse(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of the chosen features; words and hits per row."""
    counts, kinds, rows, _ = _features(data, offsets)
    n = len(offsets) - 1
    found_r, found_f, hits = [], [], np.zeros(n)
    for h, r in zip(kinds, rows, strict=True):
        if not len(hashes):
            break
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        ok = np.flatnonzero(hashes[at] == h)
        found_r.append(r[ok])
        found_f.append(at[ok])
    if not found_r:
        return np.empty(0, int), np.empty(0, int), counts, hits
    r, f = np.concatenate(found_r), np.concatenate(found_f)
    hits = np.bincount(r, minlength=n).astype(float)
    pair = np.unique(r * np.int64(len(hashes)) + f)
    return pair // len(hashes), pair % len(hashes), counts, hits


def _spread(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Per row, the share of its sentences (cut at ``.!?`` and newlines) with a word that have one of the features."""
    _, kinds, rows, places = _features(data, offsets)
    n = len(offsets) - 1
    sentence = np.cumsum(np.isin(data, _STOPS))

    def sentences(r: np.ndarray, at: np.ndarray) -> np.ndarray:
        pairs = np.unique(r * np.int64(len(data) + 1) + sentence[at])
        return np.bincount(pairs // (len(data) + 1), minlength=n)

    if not kinds or not len(hashes):
        return np.zeros(n)
    hit = [hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h for h in kinds]
    found = sentences(np.concatenate([r[x] for r, x in zip(rows, hit, strict=True)]), np.concatenate([p[x] for p, x in zip(places, hit, strict=True)]))
    return found / np.maximum(sentences(rows[0], places[0]), 1)


def _dense(counts: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Hits on a log scale, and hits per word."""
    return np.stack([np.log1p(hits), np.minimum(1.0, hits / np.maximum(counts, 1)) * 10], axis=1)


def _cumulative(z: np.ndarray, thetas: np.ndarray) -> np.ndarray:
    """P(grade <= k) for k = 0..GRADES-1, the last being 1."""
    p = 1 / (1 + np.exp(-np.clip(thetas[None, :] - z[:, None], -40, 40)))
    return np.concatenate([p, np.ones((len(z), 1))], axis=1)


def _fit_ordinal(r: np.ndarray, f: np.ndarray, dense: np.ndarray, y: np.ndarray, n_features: int, l2: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by Adam on the whole sample."""
    n = len(y)
    base = np.array([np.clip((y <= k).mean(), 1e-3, 1 - 1e-3) for k in range(GRADES - 1)])
    start = np.log(base / (1 - base))
    # theta_0, then logs of the gaps, so that thresholds stay in order
    params = [np.zeros(n_features), np.zeros(dense.shape[1]), np.r_[start[0], np.log(np.maximum(np.diff(start), 1e-2))]]
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        w, d, g = params
        thetas = np.cumsum(np.r_[g[0], np.exp(g[1:])])
        z = np.bincount(r, weights=w[f], minlength=n) + dense @ d
        cum = _cumulative(z, thetas)
        low = np.concatenate([np.zeros((n, 1)), cum[:, :-1]], axis=1)
        p = np.maximum(cum[np.arange(n), y] - low[np.arange(n), y], 1e-9)
        slope = cum * (1 - cum)
        hi = slope[np.arange(n), y] / p
        lo = np.where(y > 0, slope[np.arange(n), np.maximum(y - 1, 0)], 0) / p
        dz = (hi - lo) / n  # of the negative log-likelihood
        dtheta = np.array([-(hi[(y == k)].sum() - lo[(y == k + 1)].sum()) / n for k in range(GRADES - 1)])
        chain = np.r_[dtheta.sum(), [dtheta[k:].sum() * np.exp(g[k]) for k in range(1, GRADES - 1)]]
        grads = [np.bincount(f, weights=dz[r], minlength=n_features) + l2 * w, dense.T @ dz + l2 * d, chain]
        for i, q in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * q
            v[i] = 0.999 * v[i] + 0.001 * q * q
            params[i] = params[i] - 0.05 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    w, d, g = params
    return w, d, np.cumsum(np.r_[g[0], np.exp(g[1:])])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, keep=None) -> Model:
    """Fit on at most ``sample_rows`` labelled rows for whose id ``keep`` holds; the features are counted by Spark, the rest is small.

    Null labels and ids are ignored, an id labelled twice is toxic if either says so.  Without toxic
    labels nothing is learnt, and every text gets severity 0.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("labelled")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    known = known if keep is None else known.where(keep(F.col("labelled")))
    known = written(known.orderBy(F.xxhash64("labelled"), "labelled").limit(sample_rows), "toxicity-labels")
    sample = docs.select(F.col(id_col).alias("labelled"), F.col(text_col).alias("txt")).join(F.broadcast(known), "labelled")
    sample = written(sample.select("txt", F.col("label").alias("toxic")), "toxicity-sample")
    counts = sample.mapInArrow(_counted, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    n_toxic, n_clean = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*") - F.coalesce(F.sum("toxic"), F.lit(0))).first()
    none = Model(np.empty(0, np.uint64), np.empty(0), np.zeros(2), np.array([40.0, 41.0, 42.0]))
    if not n_toxic:
        return none
    lift = F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("c") + 0.5) / (n_clean + 1.0))
    chosen = counts.where((F.col("t") >= max(2, n_toxic // 400)) & (lift > 3.0)).withColumn("weight", lift * F.sqrt("t"))
    rows = chosen.orderBy(F.desc("weight"), "feature").limit(features).select("feature").collect()  # at most ``features`` rows
    hashes = np.sort(np.array([x[0] for x in rows], np.int64).view(np.uint64))
    if not len(hashes):
        return none

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in K.blocks(batch.column(0)):
                r, f, n, hits = _sparse(data, offsets, hashes)
                cut = np.searchsorted(r, np.arange(b - a + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(f, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(toxic[a:b], pa.int64()), lists, pa.array(n, pa.int64()), pa.array(hits), pa.array(_spread(data, offsets, hashes))], names=["toxic", "found", "n", "hits", "spread"])

    got = sample.mapInArrow(encoded, "toxic long, found array<int>, n long, hits double, spread double").toArrow()  # at most ``sample_rows`` rows
    toxic = got.column("toxic").to_numpy()
    n, hits = got.column("n").to_numpy(), got.column("hits").to_numpy()
    found = got.column("found").combine_chunks()
    f = found.flatten().to_numpy().astype(np.int64)
    r = np.repeat(np.arange(len(toxic)), np.diff(found.offsets.to_numpy()))
    share = got.column("spread").to_numpy()
    cuts = np.quantile(share[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + (share > cuts[0]) + (share > cuts[1]), 0).astype(np.int64)
    return Model(hashes, *_fit_ordinal(r, f, _dense(n, hits), grade, len(hashes)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, severity, p_toxic, grade, toxic``.

    ``severity`` is the expected grade, 0 to 3; ``p_toxic`` the probability of grade 1 or more;
    ``grade`` the likeliest; ``toxic`` whether ``p_toxic`` is at least a half.  Null, empty and
    wordless texts have no features and get the base rate's severity.  Whole texts of any length are
    read, in blocks.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.blocks(batch.column(1)):
                r, f, n, hits = _sparse(data, offsets, model.hashes)
                z = np.bincount(r, weights=model.weights[f], minlength=b - a) + _dense(n, hits) @ model.dense
                cum = _cumulative(z, model.thetas)
                p = np.diff(np.concatenate([np.zeros((b - a, 1)), cum], axis=1), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(p @ np.arange(GRADES)), pa.array(1 - cum[:, 0]), pa.array(p.argmax(axis=1), pa.int32()), pa.array(cum[:, 0] <= 0.5)],
                    names=["doc_id", "severity", "p_toxic", "grade", "toxic"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, severity double, p_toxic double, grade int, toxic boolean")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model does not call toxic."""
    model = fit(docs, labels, id_col, text_col)
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.blocks(batch.column(at)):
                r, f, n, hits = _sparse(data, offsets, model.hashes)
                z = np.bincount(r, weights=model.weights[f], minlength=b - a) + _dense(n, hits) @ model.dense
                yield batch.slice(a, b - a).filter(pa.array(_cumulative(z, model.thetas)[:, 0] > 0.5))

    return docs.mapInArrow(run, schema)
