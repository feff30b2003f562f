"""The k best items of each query: items are scored where they lie, and each task keeps k hits a query before they move.

Queries come in blocks of a bounded size that every task holds as arrays; scores of a few items at a time
are made for all of them at once.  Every item is scored against every query.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Scores of so many pairs are made at once, and so many hits are collected before all but the best go.
PAIRS, HITS = 1 << 22, 200_000
#: The score of what is no hit.
NONE = -np.inf


def rounded(s: np.ndarray) -> np.ndarray:
    """Nine decimals, halves away from zero."""
    return np.copysign(np.floor(np.abs(s) * 1e9 + 0.5), s) / 1e9 + 0.0


class Best:
    """The best k hits of each query so far: by falling rounded score (what is no number first), then by rising id."""

    def __init__(self, queries: int, k: int):
        self.k, self.queries = k, queries
        self.floor = np.full(queries, -np.finfo(float).max)  # no rounded score below it can be among the k
        self.primed, self.new = False, 0
        self.parts: list[pa.Table] = []

    def add(self, scores: np.ndarray, ids: pa.Array, beside: dict[str, pa.Array] | None = None) -> None:
        """``scores`` has a row for each query and a column for each id; what lies ``beside`` an id stays with it."""
        if not self.primed and scores.shape[1] >= self.k:
            kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            self.floor, self.primed = np.fmax(self.floor, np.where(kth == NONE, self.floor, rounded(kth))), True
        at = np.flatnonzero(~(scores < (self.floor - 1e-9)[:, None]))  # a floor is above the score of what is no hit
        q, i = at // scores.shape[1], at % scores.shape[1]
        if len(q):
            at = pa.array(i)
            self.parts.append(pa.table({"q": q, "score": rounded(scores[q, i]), "id": ids.take(at)} | {n: c.take(at) for n, c in (beside or {}).items()}))
            self.new += len(q)
        if self.new > max(HITS, 2 * self.k * self.queries):
            self.cut()

    def cut(self) -> pa.Table | None:
        if not self.parts:
            return None
        t = pa.concat_tables(self.parts)
        t = t.take(pc.sort_indices(t, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start"))
        q, score = t.column("q").to_numpy(), t.column("score").to_numpy()
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        last = np.flatnonzero(place == self.k - 1)
        self.floor[q[last]] = np.fmax(self.floor[q[last]], score[last])
        t = t.filter(pa.array(place < self.k)).combine_chunks()
        self.parts, self.new = [t], 0
        return t


def _found(items: DataFrame, who: pa.Table, kinds: StructType, k: int, scored) -> DataFrame:
    """Each task's best: the columns of ``who``, the query's, those of its item after what is scored, and ``score``.

    ``scored(batch)`` yields scores and the places of their items in the batch, some at a time.
    """
    own = [0, *range(2, len(items.columns))]  # the second column is what is scored
    fields = [kinds[c] for c in who.column_names] + [items.schema[i] for i in own]
    names = [items.columns[i] for i in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(who.num_rows, k)
        for batch in batches:
            for scores, at in scored(batch):
                rows = [batch.column(i).take(pa.array(at)) for i in own]
                best.add(scores, rows[0], dict(zip(names[1:], rows[1:], strict=True)))
        t = best.cut()
        if t is not None:
            said = who.take(t.column("q"))
            t = pa.table([*said.columns, *[t.column(n) for n in names], t.column("score")], names=[*said.column_names, *names, "score"])
            yield from t.combine_chunks().to_batches(max_chunksize=100_000)

    return items.mapInArrow(run, StructType([StructField(f.name, f.dataType) for f in fields] + [StructField("score", DoubleType())]))


def one(c: pa.ChunkedArray) -> pa.Array:
    c = c.combine_chunks()
    return c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)


def _rows(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors of the rows of each length; rows that are null, hold a null or have no length are left out."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    flat = pc.cast(pc.list_flatten(vectors), pa.float64())
    values = flat.to_numpy(zero_copy_only=False)  # null is not a number here, and marked by its row
    start = np.r_[0, np.cumsum(lengths)]
    holes = np.r_[0, np.cumsum(pc.is_null(flat).to_numpy(zero_copy_only=False))]
    sound = (lengths > 0) & (holes[start[1:]] == holes[start[:-1]])
    for d in np.unique(lengths[sound]):
        at = np.flatnonzero(sound & (lengths == d))
        v = values[start[at][:, None] + np.arange(d)]
        with np.errstate(all="ignore"):
            norm = np.sqrt(np.einsum("ij,ij->i", v, v))
            real = ~(norm == 0)
            yield at[real], v[real] / norm[real, None]


def by_cosine(items: DataFrame, asked: pa.Table, kinds: StructType, k: int) -> DataFrame:
    """For ``items(id, v)`` and one block of queries ``qid, query``, whose Spark types are ``kinds``; further columns of both come along."""
    who, wanted = asked.drop_columns(["query"]), {v.shape[1]: (at, v) for at, v in _rows(one(asked.column("query")))}

    def scored(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(64, PAIRS // max(who.num_rows, 1))
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            for at, v in _rows(part.column(1)):
                if v.shape[1] not in wanted or not len(at):
                    continue
                asks, q = wanted[v.shape[1]]
                with np.errstate(all="ignore"):
                    near = q @ v.T
                if len(asks) < who.num_rows:  # queries of another length have no hits here
                    every = np.full((who.num_rows, len(at)), NONE)
                    every[asks] = near
                    near = every
                yield near, a + at

    return _found(items, who, kinds, k, scored)


def by_terms(items: DataFrame, asked: Sequence[tuple[str, Sequence[str]]], rarity: dict[str, float], mean: float, k1: float, b: float, k: int) -> DataFrame:
    """BM25 for ``items(id, parts)``, parts being ``array<struct<dl, ts>>``, and a block of keys with their distinct terms.

    A part is a text's length and tokens; an item's parts add up.  What shares no term is no hit.
    """
    terms = sorted(t for t in rarity if rarity[t] is not None)
    place = {t: i for i, t in enumerate(terms)}
    idf, names = np.array([rarity[t] for t in terms]), pa.array(terms, pa.string())
    holders: list[list[int]] = [[] for _ in terms]
    for q, (_, said) in enumerate(asked):
        for t in said:
            if t in place:
                holders[place[t]].append(q)
    who = [np.array(h) for h in holders]
    qids = pa.array([key for key, _ in asked], pa.string())

    def scored(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(64, min(4096, PAIRS // max(len(qids), 1)))
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            n, parts = part.num_rows, part.column(1)
            item = np.repeat(np.arange(n), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
            each = pc.list_flatten(parts)
            ts = pc.struct_field(each, "ts")
            dl = pc.struct_field(each, "dl").to_numpy(zero_copy_only=False)
            own = np.repeat(np.arange(len(dl)), pc.list_value_length(ts).to_numpy(zero_copy_only=False))
            found = pc.fill_null(pc.index_in(pc.list_flatten(ts), value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            own, found = own[found >= 0], found[found >= 0]
            pair, tf = np.unique(found * max(len(dl), 1) + own, return_counts=True)  # by term, then part
            term, own = pair // max(len(dl), 1), pair % max(len(dl), 1)
            weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[own] / mean))
            scores = np.zeros((len(qids), n))
            cut = np.flatnonzero(np.r_[True, term[1:] != term[:-1], True]) if len(term) else np.zeros(1, int)
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                w = np.zeros(n)
                np.add.at(w, item[own[x:y]], weight[x:y])
                at = np.flatnonzero(w)
                scores[np.ix_(who[term[x]], at)] += w[at]
            scores[scores == 0] = NONE
            yield scores, a + np.arange(n)

    return _found(items, pa.table({"qid": qids}), StructType([StructField("qid", StringType())]), k, scored)


def in_bands(pages: DataFrame, key: str, rank: str, score: str, first: str, band: float) -> DataFrame:
    """``rank`` anew for rows that lie by key and rank: by band, then what is ``first``, then as before.

    A band ends at the first score that is more than ``band`` of its own first one below that.  Keys are
    held until the next one begins.
    """
    schema = pages.schema

    def walked(t: pa.Table) -> pa.Table:
        keys, scores = t.column(key).to_pylist(), pc.fill_null(t.column(score).cast(pa.float64()), np.nan).to_numpy().tolist()
        who, bands, last, anchor, q, b = [], [], None, None, -1, 0
        for k, s in zip(keys, scores, strict=True):
            if q < 0 or k != last:
                last, anchor, q, b = k, s, q + 1, 0
            elif anchor - s > abs(anchor) * band:
                anchor, b = s, b + 1
            who.append(q)
            bands.append(b)
        late = ~pc.fill_null(t.column(first).cast(pa.bool_()), False).to_numpy()
        q = np.array(who)
        order = np.lexsort((np.arange(len(q)), late, np.array(bands), q))  # rows of a key stay where the key's rows are
        place = np.arange(len(q)) - np.searchsorted(q, q) + 1
        at = t.column_names.index(rank)
        return t.take(pa.array(order)).set_column(at, t.schema.field(at), pa.chunked_array([pa.array(place).cast(t.schema.field(at).type)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            keys = t.column(key).to_pylist()
            cut = len(keys)
            while cut and keys[cut - 1] == keys[-1]:
                cut -= 1
            whole = cut > 0 or (held and held[-1].column(key)[-1].as_py() != keys[-1])
            if whole:
                yield from walked(pa.concat_tables([*held, t.slice(0, cut)])).to_batches()
                held = []
            held.append(t.slice(cut))
        if held:
            yield from walked(pa.concat_tables(held)).to_batches()

    return pages.mapInArrow(run, schema)


def parts_of(base: DataFrame, unique: bool) -> DataFrame:
    """``id, parts`` of ``base(id, dl, ts)``; texts of one id and length are one part."""
    if unique:
        return base.select("id", F.array(F.struct("dl", "ts")).alias("parts"))
    joined = base.groupBy("id", "dl").agg(F.flatten(F.collect_list("ts")).alias("ts"))
    return joined.groupBy("id").agg(F.collect_list(F.struct("dl", "ts")).alias("parts"))


def held_by(base: DataFrame, terms: DataFrame, unique: bool) -> DataFrame:
    """``term, df, n, words``: how many ids hold each of ``terms(term)``; under the empty term, which no text has,
    the number ``n`` of all rows and that of their ``words``: one pass over the texts gives both."""
    df: Column = F.count("*") if unique else F.countDistinct("id")
    wanted = terms.unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term")))
    said = base.select("id", "dl", F.explode(F.array_append(F.array_distinct("ts"), F.lit(""))).alias("term"))
    return said.join(F.broadcast(wanted), "term").groupBy("term").agg(df.alias("df"), F.count("*").alias("n"), F.sum("dl").alias("words"))
