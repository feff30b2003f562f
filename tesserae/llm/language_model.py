"""A gated recurrent language model over words: training, and whole-document log-likelihood.

Counts of all training words come first, summed in each task before they are shuffled.  The counts
of the most frequent words, ``FREQUENT`` at most, are sent to every task; only the pairs of a text and
a rarer word are dealt by word, counted, and their sums sent back to the texts, so that no word that
much of the corpus has lands in one task.  The most frequent words make the model's vocabulary; a word
outside it is predicted as "unknown" and then by its count among the unknown, so every text has a true
probability and the counts of the whole corpus enter it.

The network is a gated recurrent unit in numpy whose softmax is factored into word classes.  It is
trained by truncated backpropagation over all windows of every training text, with the state carried
from window to window through runs of ``TRAIN_RUN`` tokens.  Each task trains on its own texts; the
networks are averaged by the words they saw.  The second round starts from the average and has the
other half of the texts.  Scoring carries the state across all windows of a text, from its first word to its end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import written

CLASSES = 32
PER_CLASS = 32
VOCABULARY = CLASSES * PER_CLASS - 2
UNKNOWN, END = 0, 1
HIDDEN = 16
ROUNDS = 2
TRAIN_SLOTS, TRAIN_STEPS = 256, 16
#: Tokens through which training carries the state, at most; tokens from one step of the weights to the next.
TRAIN_RUN, UPDATE, WARM_UP = 1024, 4096, 10
SCORE_SLOTS, SCORE_STEPS = 256, 32
RATE = 0.02
#: Words whose counts are sent to every task (16 bytes each).
FREQUENT = 1 << 18
#: Distinct words that a task counts before it sends their sums on.
COUNTED = 2_000_000
#: (text, rare word) pairs that one dealt bucket holds in a worker's memory.
DEALT = 3_000_000
LOG10 = math.log(10)


# --- counts -----------------------------------------------------------------------------------


def _hashed(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, K.Words, np.ndarray]]:
    for a, b, data, offsets in K.blocks(batch.column(column)):
        low = K.LOWER[data]
        words = K.Words(low, offsets)
        yield a, b, words, K.word_hashes(low, words)


def _at(hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of ``h`` in sorted hashes, -1 where it is not among them."""
    if not len(hashes):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return np.where(hashes[at] == h, at, -1)


def _summed(h: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct hashes, and the sums of the others by hash."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, int)
    return h[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in sums)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their times in training texts and in all texts, summed over the task or a large part of it."""
    parts, held = [], 0

    def flush(total: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total[0].view(np.int64)), pa.array(total[1]), pa.array(total[2])], names=["word", "train", "every"])

    for batch in batches:
        train = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b, words, h in _hashed(batch, 1):
            parts.append(_summed(h, train[a:b][words.rows], np.ones(len(h), np.int64)))
            held += len(parts[-1][0])
            if held >= COUNTED:
                total = _summed(*(np.concatenate(p) for p in zip(*parts, strict=True)))
                parts, held = [total], len(total[0])
                if held >= COUNTED // 2:
                    yield flush(total)
                    parts, held = [], 0
    if parts:
        yield flush(_summed(*(np.concatenate(p) for p in zip(*parts, strict=True))))


def _dealt(buckets: int, frequent: np.ndarray):
    """Packed blocks of (text, rare word, times): bucket, texts, whether they train, pairs of each, hashes, times."""

    def flush(parts: list) -> pa.RecordBatch:
        key, train, own, h, times = (np.concatenate([p[i] for p in parts]) for i in range(5))
        bucket = (h % K.U64(buckets)).astype(np.int64)
        order = np.lexsort((own, bucket))
        own, h, times, bucket = own[order], h[order], times[order], bucket[order]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        cols: list[list] = [[] for _ in range(6)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            who, n = np.unique(own[a:b], return_counts=True)
            for c, v in zip(cols, (int(bucket[a]), key[who].tobytes(), train[who].tobytes(), n.astype(np.uint32).tobytes(), h[a:b].tobytes(), times[a:b].astype(np.uint32).tobytes()), strict=True):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "keys", "train", "counts", "hashes", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, texts, held = [], 0, 0
        for batch in batches:
            keys = batch.column(0).to_numpy()
            train = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, words, h in _hashed(batch, 2):
                rare = _at(frequent, h) < 0
                h, rows = h[rare], words.rows[rare]
                order = np.lexsort((h, rows))
                hs, rs = h[order], rows[order]
                first = np.flatnonzero(np.r_[True, (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])]) if len(hs) else np.empty(0, int)
                parts.append((keys[a:b], train[a:b].astype(np.uint8), rs[first] + texts, hs[first], np.diff(np.r_[first, len(hs)])))
                texts += b - a
                held += len(first)
                if held >= 1_000_000:
                    yield flush(parts)
                    parts, texts, held = [], 0, 0
        if held:
            yield flush(parts)

    return run


def _bucket_counts(table: pa.Table) -> pa.Table:
    """Each text's known words among the bucket's, and their sum of log10(c + 0.1)."""

    def all_of(name: str, kind) -> np.ndarray:
        return np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)])

    counts = all_of("counts", np.uint32)
    keys, train = all_of("keys", np.int64), np.repeat(all_of("train", np.uint8), counts)
    texts, own = np.unique(keys, return_inverse=True)
    own = np.repeat(own, counts)
    h, times = all_of("hashes", np.uint64), all_of("times", np.uint32).astype(np.int64)
    words, inverse = np.unique(h, return_inverse=True)
    c = np.bincount(inverse, weights=times * train, minlength=len(words))
    known = np.bincount(own, weights=np.where(c[inverse] > 0, times, 0), minlength=len(texts))
    sums = np.bincount(own, weights=np.log10(c + 0.1)[inverse] * times, minlength=len(texts))
    return pa.table([pa.array(texts), pa.array(known), pa.array(sums)], names=["key", "known", "logs"])


# --- the network ------------------------------------------------------------------------------

_SIZE = CLASSES * PER_CLASS
SHAPES = {"x": (_SIZE, 3 * HIDDEN), "u": (HIDDEN, 2 * HIDDEN), "c": (HIDDEN, HIDDEN), "g": (3 * HIDDEN,), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "wo": (_SIZE, HIDDEN), "bo": (_SIZE,)}
Net = dict[str, np.ndarray]


def start_net(counts: np.ndarray, seed: int = 3) -> Net:
    """Small random weights; biases at the logs of the counts, so that it starts as the unigram model."""
    rng = np.random.default_rng(seed)
    net = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    by_class = counts.reshape(CLASSES, PER_CLASS)
    classes = by_class.sum(1) + 0.5
    net["bc"] = np.log(classes / classes.sum()).astype(np.float32)
    smooth = by_class + 0.1 / _SIZE
    net["bo"] = np.log(smooth / smooth.sum(1, keepdims=True)).ravel().astype(np.float32)
    net["g"][:] = 0
    net["wc"] *= 0.1
    net["wo"] *= 0.1
    return net


def flat(net: Net) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in SHAPES])


def unflat(values: np.ndarray) -> Net:
    net, at = {}, 0
    for k, s in SHAPES.items():
        n = math.prod(s)
        net[k] = values[at : at + n].reshape(s).astype(np.float32)
        at += n
    return net


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def _unroll(net: Net, x: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, list]:
    """States that follow each input; the last state; what backpropagation needs."""
    hidden, saved = HIDDEN, []
    inputs = net["x"][x] + net["g"]
    out = np.empty((len(x), len(h), hidden), np.float32)
    for t in range(len(x)):
        a = inputs[t]
        zr = _sigmoid(a[:, : 2 * hidden] + h @ net["u"])
        z, r = zr[:, :hidden], zr[:, hidden:]
        rh = r * h
        c = np.tanh(a[:, 2 * hidden :] + rh @ net["c"])
        new = h + z * (c - h)
        if keep:
            saved.append((h, z, r, rh, c))
        out[t] = h = new
    return out, h, saved


def _exps(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, their exponentials and the sums of those by row; scores are lowered only if they overflow."""
    e = np.exp(v)
    total = e @ np.ones(v.shape[1], np.float32)
    if not np.isfinite(total).all():
        v = v - v.max(axis=1, keepdims=True)
        e = np.exp(v)
        total = e.sum(axis=1)
    return v, e, total


def _output(net: Net, h: np.ndarray, y: np.ndarray, grads: Net | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probabilities of the words y after the states h; with ``grads``, also the loss's gradient at h."""
    cls = y // PER_CLASS
    order = np.argsort(cls, kind="stable")
    cut = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    h, at = h[order], np.arange(len(y))
    cls, inner = cls[order], y[order] % PER_CLASS
    v, e, total = _exps(h @ net["wc"] + net["bc"])
    logp = v[at, cls] - np.log(total)
    dh = None
    if grads is not None:
        e /= total[:, None]
        e[at, cls] -= 1
        grads["wc"] += h.T @ e
        grads["bc"] += e.sum(0)
        dh = e @ net["wc"].T
    for k in range(CLASSES):
        rows = slice(cut[k], cut[k + 1])
        if cut[k] == cut[k + 1]:
            continue
        own = slice(k * PER_CLASS, (k + 1) * PER_CLASS)
        hk, w, at = h[rows], net["wo"][own], np.arange(cut[k + 1] - cut[k])
        v, e, total = _exps(hk @ w.T + net["bo"][own])
        logp[rows] += v[at, inner[rows]] - np.log(total)
        if grads is not None:
            e /= total[:, None]
            e[at, inner[rows]] -= 1
            grads["wo"][own] += e.T @ hk
            grads["bo"][own] += e.sum(0)
            dh[rows] += e @ w
    back = np.empty(len(y), np.int64)
    back[order] = np.arange(len(y))
    return logp[back], None if dh is None else dh[back]


def _backward(net: Net, x: np.ndarray, saved: list, dout: np.ndarray, grads: Net) -> None:
    """Backpropagation through the window; the state that came in is a constant."""
    hidden = HIDDEN
    carry = np.zeros_like(dout[0])
    da = np.empty((len(x), dout.shape[1], 3 * hidden), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, z, r, rh, c = saved[t]
        d = dout[t] + carry
        dc = d * z * (1 - c * c)
        drh = dc @ net["c"].T
        dz = d * (c - h) * z * (1 - z)
        dr = drh * h * r * (1 - r)
        dzr = np.concatenate([dz, dr], axis=1)
        grads["u"] += h.T @ dzr
        grads["c"] += rh.T @ dc
        da[t, :, : 2 * hidden], da[t, :, 2 * hidden :] = dzr, dc
        carry = d * (1 - z) + drh * r + dzr @ net["u"].T
    flat_da, flat_x = da.reshape(-1, 3 * hidden), x.ravel()
    grads["g"] += flat_da.sum(0)
    order = np.argsort(flat_x, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(flat_x[order]) != 0])
    grads["x"][flat_x[order][first]] += np.add.reduceat(flat_da[order], first, axis=0)


def _windows(tokens: np.ndarray, begin: np.ndarray, end: np.ndarray, slots: int, steps: int, most: int = 0):
    """Runs of ``tokens[begin:end]`` through a fixed number of slots, each refilled when its run ends.

    Yields inputs and targets of shape (steps, slots), a mask, the run in each slot, and the slots
    whose state starts anew.  As slots run out, windows grow to ``most`` steps.  A text's first input is END.  Longer runs go first.
    """
    order = np.argsort(begin - end, kind="stable")
    queue = 0
    slots = max(1, min(slots, len(order)))
    run, at = np.full(slots, -1), np.zeros(slots, np.int64)
    most = max(steps, most)
    ramp = np.arange(most)[:, None]
    padded = np.concatenate([tokens, np.zeros(most + 1, tokens.dtype)])
    while True:
        free = np.flatnonzero((run < 0) | (at >= end[run]))
        n = min(len(free), len(order) - queue)
        fresh = free[:n]
        run[fresh] = order[queue : queue + n]
        at[fresh] = begin[run[fresh]]
        run[free[n:]] = -1
        queue += n
        live = np.flatnonzero(run >= 0)
        if not len(live):
            return
        if len(live) < len(run):  # the end of the input: fewer and fewer slots
            keep = live
            run, at = run[keep], at[keep]
            fresh = np.searchsorted(keep, fresh)
        else:
            keep = None
        place = at[None, :] + ramp[: min(most, steps * slots // len(run))]
        mask = place < end[run][None, :]
        place = np.minimum(place, len(padded) - 1)
        y = padded[place]
        x = np.where(place == 0, END, padded[place - 1])  # before a text comes the end of another
        yield x, y, mask, run, fresh, keep
        at = at + len(place)


class _Adam:
    """Weights stepped by the mean gradient of every ``UPDATE`` tokens or a little more, however few a window has."""

    def __init__(self, net: Net):
        self.net, self.steps, self.tokens = net, 0, 0
        self.grads, self.m, self.v = ({k: np.zeros_like(p) for k, p in net.items()} for _ in range(3))

    def saw(self, tokens: int) -> None:
        self.tokens += tokens
        if self.tokens >= UPDATE:
            self.step()

    def step(self) -> None:
        if not self.tokens:
            return
        self.steps += 1
        rate = RATE * min(1.0, self.steps / WARM_UP) / (1 - 0.9**self.steps)
        least = 1e-6 * (spread := math.sqrt(1 - 0.99**self.steps))
        for k, g in self.grads.items():
            g /= self.tokens
            m, v = self.m[k], self.v[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            self.net[k] -= (rate * spread) * m / (np.sqrt(v) + least)
            g[:] = 0
        self.tokens = 0


def _runs(first: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of at most ``longest`` tokens begin and end that together cover all texts: a long text has many."""
    size = np.diff(first)
    n = -(-size // longest)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(first[:-1], n) + at * longest
    return begin, np.minimum(begin + longest, np.repeat(first[1:], n))


def _train(net: Net, batches: Iterator[pa.RecordBatch], vocabulary: tuple[np.ndarray, np.ndarray]) -> int:
    seen, adam = 0, _Adam(net)
    for batch in batches:
        tokens, first = _tokens(batch, 1, vocabulary)
        h = None
        for x, y, mask, _, fresh, keep in _windows(tokens, *_runs(first, TRAIN_RUN), TRAIN_SLOTS, TRAIN_STEPS):
            if h is None:
                h = np.zeros((x.shape[1], HIDDEN), np.float32)
            elif keep is not None:
                h = h[keep]
            h = h.copy()
            h[fresh] = 0
            states, last, saved = _unroll(net, x, h, True)
            on = mask.ravel()
            _, dh = _output(net, states.reshape(-1, HIDDEN)[on], y.ravel()[on], adam.grads)
            dout = np.zeros((on.size, HIDDEN), np.float32)
            dout[on] = dh
            _backward(net, x, saved, dout.reshape(states.shape), adam.grads)
            n = int(on.sum())
            adam.saw(n)
            seen += n
            h = last
    adam.step()
    return seen


def _tokens(batch: pa.RecordBatch, column: int, vocabulary: tuple[np.ndarray, np.ndarray], unknown: int = UNKNOWN, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all texts' words, each text followed by END, and where each text starts."""
    hashes, numbers = vocabulary
    every = np.r_[numbers, unknown].astype(np.int64)  # a place of -1 is the last
    parts, lengths = [], []
    for _, _, words, h in _hashed(batch, column):
        parts.append(np.insert(every[_at(hashes, h)], words.first[1:], end))
        lengths.append(words.counts + 1)
    if not parts:
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    return np.concatenate(parts).astype(np.int64), np.r_[0, np.cumsum(np.concatenate(lengths))]


def log_likelihood(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``held_out`` is a boolean column; rows where it is true (or null) are not learnt from.  Tokens are
    the words of the whole text after lower-casing A-Z, then one end; a null text is empty, with the
    end alone.  ``base_score`` is the log10 probability under the smoothed counts of all training
    tokens, ``score`` under the model.  Rows that repeat an id are scored each alone; other columns
    are ignored; without training rows all counts are 0 and the model stays as it starts.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("txt"))
    training = ~F.col("held_out")
    n_train, size = rows.agg(F.count_if(training), F.coalesce(F.sum(F.octet_length("txt")), F.lit(0))).first()
    counted = rows.select(training.alias("train"), "txt").mapInArrow(_counted, "word long, train long, every long")
    counted = written(counted.groupBy("word").agg(F.sum("train").alias("train"), F.sum("every").alias("every")), "lm-words")
    n_words, n_distinct = counted.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0)).first()
    train_tokens, distinct = n_words + n_train, n_distinct + (n_train > 0)
    top = counted.orderBy(F.desc("every"), "word").limit(FREQUENT).select("word", "train").toArrow()  # at most FREQUENT rows
    frequent = top.column("word").to_numpy().view(np.uint64)
    order = np.argsort(frequent)
    frequent, times = frequent[order], top.column("train").to_numpy()[order]
    # numbers go by falling count after the two marks, so that frequent words share classes
    chosen = np.lexsort((frequent, -times))[:VOCABULARY]
    chosen = chosen[times[chosen] > 0]
    c = times[chosen]
    vocabulary = np.full(len(frequent), UNKNOWN)
    vocabulary[chosen] = 2 + np.arange(len(chosen))
    every = np.zeros(_SIZE)
    every[END], every[UNKNOWN] = n_train, n_words - c.sum()
    every[2 : 2 + len(c)] = c
    order = np.sort(chosen)
    inside = (frequent[order], vocabulary[order])
    buckets = min(1 << 20, max(24, size // (10 * DEALT)))
    dealt = rows.select("key", training.alias("train"), "txt").mapInArrow(_dealt(buckets, frequent), "bucket long, keys binary, train binary, counts binary, hashes binary, times binary")
    rare = dealt.groupBy("bucket").applyInArrow(_bucket_counts, "key long, known double, logs double")

    net = start_net(every)
    for turn in range(ROUNDS):
        values = flat(net)

        def run(batches: Iterator[pa.RecordBatch], values=values) -> Iterator[pa.RecordBatch]:
            own = unflat(values.copy())
            seen = _train(own, batches, inside)
            if seen:
                out = flat(own).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out * seen), pa.array(np.full(len(out), float(seen)))], names=["i", "v", "w"])

        part = rows.where(~F.col("held_out") & (F.pmod("key", F.lit(ROUNDS)) == turn)).select("key", "txt")
        train = part.mapInArrow(run, "i int, v double, w double").groupBy("i").agg(F.sum("v").alias("v"), F.sum("w").alias("w")).toArrow()  # one row per weight
        if train.num_rows:
            new = values.copy()
            new[train.column("i").to_numpy()] = train.column("v").to_numpy() / train.column("w").to_numpy()
            net = unflat(new)
    values = flat(net)
    # of a word's place among the frequent, then of none (a rare word) and of the end
    rest = math.log10(max(n_words - c.sum(), 0) + 0.1 * (n_distinct - len(c) + 1))
    number = np.r_[vocabulary, UNKNOWN, END]
    log = np.r_[np.log10(times + 0.1), 0, 0]
    among = np.where(number == UNKNOWN, log - rest, 0)  # a word's log-probability among the unknown
    known = np.r_[times > 0, False, False]
    place = (frequent, np.arange(len(frequent)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = unflat(values)
        for batch in batches:
            at, first = _tokens(batch, 3, place, len(frequent), len(frequent) + 1)
            tokens = number[at]
            n = len(first) - 1
            total = np.zeros(n)
            h = None
            for x, y, mask, run, fresh, keep in _windows(tokens, first[:-1], first[1:], SCORE_SLOTS, SCORE_STEPS, 16 * SCORE_STEPS):
                if h is None:
                    h = np.zeros((len(run), HIDDEN), np.float32)
                elif keep is not None:
                    h = h[keep]
                h = h.copy()
                h[fresh] = 0
                states, h, _ = _unroll(own, x, h, False)
                on = mask.ravel()
                logp, _ = _output(own, states.reshape(-1, HIDDEN)[on], y.ravel()[on])
                total += np.bincount(np.broadcast_to(run, mask.shape).ravel()[on], weights=logp, minlength=n)
            of_text = lambda x: np.add.reduceat(x[at], first[:-1]) if n else x[:0]  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(first)), pa.array(total / LOG10 + of_text(among)), pa.array(of_text(log)), pa.array(of_text(known.astype(np.int64)))],
                names=["doc_id", "held_out", "key", "n_tokens", "net", "logs", "known"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    scored = rows.select("doc_id", "held_out", "key", "txt").mapInArrow(score, f"doc_id {kind}, held_out boolean, key long, n_tokens long, net double, logs double, known long")
    sums = rare.groupBy("key").agg(F.sum("known").alias("k"), F.sum("logs").alias("l"))
    same = rows.groupBy("key").agg(F.count("*").alias("same"))
    sums = sums.join(same, "key").select("key", (F.col("k") / F.col("same")).alias("rare_known"), (F.col("l") / F.col("same")).alias("rare_logs"))
    both = scored.join(sums, "key", "left")
    zero = F.lit(0.0)
    rare_logs = F.coalesce("rare_logs", zero)
    base = F.col("logs") + rare_logs + math.log10(n_train + 0.1) - F.col("n_tokens") * math.log10(train_tokens + 0.1 * (distinct + 1))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.round(F.coalesce("rare_known", zero)) + F.lit(int(n_train > 0))).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("net") + rare_logs).alias("score"),
    )
