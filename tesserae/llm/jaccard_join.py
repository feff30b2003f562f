"""N-gram Jaccard self-join by vertical partitioning.

The shingles of all texts have one global order, by rarity.  It is cut into fragments; a text has
one segment in each.  Overlaps are counted per fragment and summed per pair, so that no task needs
two whole texts together.  Steps:

1.  Texts with equal shingle sets are one class; only classes are joined.
2.  Shingles are dealt by hash, each class's in packed blocks, and get their class frequency.  Those
    of a single class cannot overlap anything and go no further.
3.  Back at their class, shingles are put in global order.  A class whose shared shingles are fewer
    than 75% of its set has no partner.  For the rest the prefix (the rarest 25% and one) must meet
    the prefix of any partner.
4.  Candidates meet on prefix shingles under the length and positional bounds.  First each prefix
    shingle's classes are compared with one hub, and linked classes are merged; then what is left
    in different components is compared exactly.  A dense group of copies thus costs its size, not
    its square, and no link between components is lost.
5.  A pair is verified by its fragments' partial overlaps.

The prefix is kept beside the fragments because segments of one fragment alone meet too often: every
text with a common phrase would meet every other.  Fragments then count each candidate's overlap.

A shingle that very many classes hold is never dealt to one task: such shingles are found in a sample
of the distinct texts, sent to every task (``HOT_NAMES`` at most), named there as the last of the global
order, and go straight to their class.  The sample decides where work is done, never what is found.

Fingerprints of sets and shingles have 64 bits.  Of n distinct texts about n * n / 3.7e19 pairs are
taken for equal though they differ: none is expected up to 10^9 texts, about 3 at 10^10.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import components, join_unique, written

PERCENT = 75
SHINGLE = 5
#: Shingles that one dealt fragment holds in a worker's memory.
DEALT = 2_000_000
#: Pieces of the global order in which overlaps are counted.
FRAGMENTS = 8
HUB_ROUNDS = 2
#: A shingle of more classes is hot; one text in so many is looked at to find them; so many are named, most frequent first.
HOT_CLASSES, HOT_SAMPLE, HOT_NAMES = 250_000, 256, 1 << 16


def _needed(n: int, percent: int) -> int:
    """The least overlap that a set of n shares with any partner."""
    return -(-percent * n // 100)


def _digests(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.blocks(batch.column(1)):
                sets = K.shingle_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(2)[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array([K.set_digest(s) for s in sets], pa.int64())],
                    names=["doc_id", "rk", "n_shingles", "cls"],
                )

    return run


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """Per row: id, hash of id and text, number of distinct shingles, and the fingerprint of the set."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(F.col(id_col), F.col(text_col)))
    return rows.mapInArrow(_digests(k), f"doc_id {kind}, rk long, n_shingles long, cls long")


def _members(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in K.blocks(batch.column(0)):
                h = np.concatenate(K.shingle_sets(data, offsets, k))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return run


def hot_shingles(docs: DataFrame, text_col: str, k: int, hot_classes: int) -> np.ndarray:
    """Sorted hashes of the shingles that more than about ``hot_classes`` distinct texts hold."""
    text = F.col(text_col)
    sample = docs.where(F.pmod(F.xxhash64(text), F.lit(HOT_SAMPLE)) == 0).groupBy(F.xxhash64(text, F.lit(1))).agg(F.min(text).alias("txt"))
    held = sample.select("txt").mapInArrow(_members(k), "h long").groupBy("h").agg(F.count("*").alias("held"))
    top = held.where(F.col("held") * HOT_SAMPLE > hot_classes).orderBy(F.desc("held"), "h").limit(HOT_NAMES)
    return np.sort(np.array([r.h for r in top.collect()], np.int64).view(np.uint64))  # at most HOT_NAMES


def _dealt(k: int, buckets: int, hot: np.ndarray):
    """Packed blocks (bucket, classes, set sizes, counts, hashes): the hashes of a bucket, class by class.

    Bucket -1 - g has the names of hot shingles of the classes of group g.
    """

    def packed(cols: list[list], bucket: np.ndarray, own: np.ndarray, values: np.ndarray, cls: np.ndarray, sizes: np.ndarray) -> None:
        order = np.argsort(bucket, kind="stable")
        values, own, bucket = values[order], own[order], bucket[order]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            who, n = np.unique(own[a:b], return_counts=True)
            for c, v in zip(cols, (int(bucket[a]), cls[who].tobytes(), sizes[who].tobytes(), n.astype(np.uint32).tobytes(), values[a:b].tobytes()), strict=True):
                c.append(v)

    def flush(sets: list[np.ndarray], ids: list[int]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets], np.uint32)
        h = np.concatenate(sets)
        own = np.repeat(np.arange(len(sets)), sizes)
        cls = np.array(ids, np.int64)
        cols: list[list] = [[], [], [], [], []]
        if len(hot):
            at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
            is_hot = hot[at] == h
            group = (cls.view(np.uint64) % K.U64(buckets)).astype(np.int64)[own[is_hot]]
            packed(cols, -1 - group, own[is_hot], _HOT | at[is_hot].astype(np.int64), cls, sizes)
            h, own = h[~is_hot], own[~is_hot]
        packed(cols, (h % K.U64(buckets)).astype(np.int64), own, h, cls, sizes)
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "cls", "n", "counts", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sets: list[np.ndarray] = []
        ids: list[int] = []
        held = 0
        for batch in batches:
            for _, _, data, offsets in K.blocks(batch.column(0)):
                for s in K.shingle_sets(data, offsets, k):
                    if not len(s) or (c := K.set_digest(s)) in seen:
                        continue
                    if len(seen) < 1_000_000:  # only spares a later step the copies
                        seen.add(c)
                    sets.append(s)
                    ids.append(c)
                    held += len(s)
                if held >= 1_500_000:
                    yield flush(sets, ids)
                    sets, ids, held = [], [], 0
        if sets:
            yield flush(sets, ids)

    return run


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The classes, their sizes, and the hashes with their class, of a bucket's blocks."""

    def all_of(name: str, kind) -> np.ndarray:
        return np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)])

    counts = all_of("counts", np.uint32)
    return np.repeat(all_of("cls", np.int64), counts), np.repeat(all_of("n", np.uint32), counts), all_of("hashes", np.uint64)


def _shared(groups: int):
    """Within a bucket: shingles of two classes or more, named in global order, dealt back to classes."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:  # hot shingles have their names and go on to their classes
            return table.set_column(0, "bucket", pa.array(np.full(table.num_rows, -1 - bucket)))
        cls, n, h = _unpack(table)
        order = np.lexsort((cls, h))
        cls, n, h = cls[order], n[order], h[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])]
        cls, n, h = cls[new], n[new], h[new]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        df = np.diff(np.r_[start, len(h)])
        # rarer first: 8 bits of frequency, then bucket, then rank: a number that orders all shingles
        code = np.minimum(255, np.round(8 * np.log2(df))).astype(np.int64)
        name = (code << 54) | (np.int64(bucket) << 32) | np.arange(len(df), dtype=np.int64)
        keep = np.repeat(df >= 2, df)
        name, cls, n = np.repeat(name, df)[keep], cls[keep], n[keep]
        group = (cls.view(np.uint64) % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((name, cls, group))
        name, cls, n, group = name[order], cls[order], n[order], group[order]
        cols: list[list] = [[], [], [], [], []]
        cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else np.zeros(1, int)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            first = np.flatnonzero(np.r_[True, cls[a + 1 : b] != cls[a : b - 1]]) + a
            for c, v in zip(cols, (int(group[a]), cls[first].tobytes(), n[first].tobytes(), np.diff(np.r_[first, b]).astype(np.uint32).tobytes(), name[a:b].tobytes()), strict=True):
                c.append(v)
        return pa.table([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "cls", "n", "counts", "hashes"])

    return run


def _live(percent: int):
    """Classes that share enough shingles to have a partner, with those shingles in global order."""

    def run(table: pa.Table) -> pa.Table:
        cls, n, name = _unpack(table)
        name = name.view(np.int64)
        order = np.lexsort((name, cls))
        cls, n, name = cls[order], n[order], name[order]
        new = np.r_[True, (name[1:] != name[:-1]) | (cls[1:] != cls[:-1])]  # copies of a class in several tasks name its hot shingles each
        cls, n, name = cls[new], n[new], name[new]
        cut = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1], True])
        rows = [(int(cls[a]), int(n[a]), name[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True) if b - a >= _needed(int(n[a]), percent)]
        return pa.table(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
            names=["cls", "n", "tokens"],
        )

    return run


#: Names of hot shingles come after all others.
_HOT = np.int64(1 << 62)
_PACKED = "bucket long, cls binary, n binary, counts binary, hashes binary"


def _within(n: Column, m: Column, i: Column, j: Column, percent: int) -> Column:
    """Length and positional bounds: sets of n and m that first meet at places i and j can still link."""
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * F.least(n - i, m - j) >= percent * (n + m))


def _piece(lo: int, hi: int) -> Column:
    return F.filter("tokens", lambda x: (x >= lo) & (x < hi))


def _verified(pairs: DataFrame, live: DataFrame, pivots: list[int], percent: int) -> DataFrame:
    """The pairs that link: overlaps are counted fragment by fragment, then summed."""
    bounds = [-(1 << 62), *pivots, (1 << 63) - 1]
    pieces = F.array(*[_piece(lo, hi) for lo, hi in zip(bounds, bounds[1:], strict=False)])
    a = pairs.join(live.select(F.col("cls").alias("a"), F.col("n").alias("na"), "tokens"), "a").select("a", "b", "na", F.posexplode(pieces).alias("fragment", "left"))
    b = pairs.select("b").distinct().join(live.select(F.col("cls").alias("b"), F.col("n").alias("nb"), "tokens"), "b").select("b", "nb", F.posexplode(pieces).alias("fragment", "right"))
    part = a.join(b, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("left", "right")).alias("part"))
    total = part.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("overlap"))
    return total.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")


def _labelled(prefix: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return prefix.withColumn("comp", F.col("cls"))
    return prefix.join(labels.withColumnRenamed("v", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")


def _hub_pairs(entries: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each prefix shingle's classes against one of them."""
    order = F.struct("lonely", "cls") if turn == 0 else F.struct(F.xxhash64("cls", F.lit(turn)), "cls")
    hubs = entries.groupBy("token").agg(F.min_by(F.struct("cls", "n", "i", "comp"), order).alias("hub"), (F.min("comp") < F.max("comp")).alias("mixed")).where("mixed")
    met = join_unique(entries, hubs.select("token", "hub"), "token")
    met = met.where((F.col("comp") != F.col("hub.comp")) & _within(F.col("n"), F.col("hub.n"), F.col("i"), F.col("hub.i"), percent))
    return met.select(F.least("cls", "hub.cls").alias("a"), F.greatest("cls", "hub.cls").alias("b")).distinct()


def _rest_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """All pairs in different components: those outside a shingle's main component against all of its classes."""
    sizes = entries.groupBy("token", "comp").agg(F.count("*").alias("size"))
    main = sizes.groupBy("token").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    open_ = entries.join(main, "token")
    few = open_.where("comp <> main").select("token", F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("i").alias("ix"), F.col("comp").alias("cx"))
    met = open_.join(few, (open_["token"] == few["token"]) & (F.col("comp") != F.col("cx")) & _within(F.col("n"), F.col("nx"), F.col("i"), F.col("ix"), percent))
    return met.select(F.least("cls", "x").alias("a"), F.greatest("cls", "x").alias("b")).distinct()


def link_classes(docs: DataFrame, n_shingles: int, n_texts: int, text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, hot_classes: int = HOT_CLASSES) -> DataFrame:
    """Components of classes: rows ``(v, component)`` for classes that have a link to another text."""
    buckets = min(1 << 21, max(64, math.ceil(n_shingles / DEALT)))
    hot = hot_shingles(docs, text_col, k, hot_classes) if n_texts > hot_classes else np.empty(0, np.uint64)  # none has more classes than there are texts
    dealt = docs.select(text_col).mapInArrow(_dealt(k, buckets, hot), _PACKED)
    shared = dealt.groupBy("bucket").applyInArrow(_shared(buckets), _PACKED)
    live = written(shared.groupBy("bucket").applyInArrow(_live(percent), "cls long, n long, tokens array<long>"), "jaccard-live")
    pivots = [int(x) for x in live.select(F.explode("tokens").alias("t")).agg(F.percentile_approx("t", [i / FRAGMENTS for i in range(1, FRAGMENTS)], 1000)).first()[0] or []]
    lonely = F.col("n") - F.size("tokens")
    reach = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - lonely).cast("int")
    prefix = live.select("cls", "n", lonely.alias("lone"), (lonely / F.col("n")).alias("lonely"), F.posexplode(F.slice("tokens", 1, F.greatest(reach, F.lit(0)))).alias("pos", "token"))
    prefix = written(prefix.select("cls", "n", "lonely", "token", (F.col("lone") + F.col("pos")).alias("i")), "jaccard-prefix")
    links, labels = None, None
    for turn in range(HUB_ROUNDS + 1):
        entries = written(_labelled(prefix, labels), "jaccard-entries")
        pairs = written(_hub_pairs(entries, turn, percent) if turn < HUB_ROUNDS else _rest_pairs(entries, percent), "jaccard-pairs")
        found = written(_verified(pairs, live, pivots, percent), "jaccard-links")
        links = found if links is None else links.union(found)
        labels = components(links, "jaccard-components")
    return labels


def _classed(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, hot_classes: int) -> DataFrame:
    """Rows with a shingle or without: ``doc_id, rk, n_shingles, cls, class_id, class_size, comp, component_id, shared``.

    ``shared`` is false where the row alone makes up its component.
    """
    rows = written(digests(docs, id_col, text_col, k), "jaccard-digests")
    total, texts = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count_if(F.col("n_shingles") > 0)).first()
    labels = link_classes(docs, total, texts, text_col, k, percent, hot_classes)
    classes = rows.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    classes = written(classes.join(labels.withColumnRenamed("v", "cls"), "cls", "left"), "jaccard-classes")
    # only classes with a link need to look up their component's smallest id
    linked = classes.where("component is not null").withColumnRenamed("component", "comp")
    least = linked.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    linked = join_unique(written(linked, "jaccard-linked"), least, "comp")
    single = classes.where("component is null").select("class_id", "class_size", "cls", F.col("cls").alias("comp"), F.col("class_id").alias("component_id"))
    linked, single = linked.withColumn("shared", F.lit(True)), single.withColumn("shared", F.col("class_size") > 1)
    every = written(linked.unionByName(single.select(linked.columns)), "jaccard-members")
    found = join_unique(rows.where("n_shingles > 0"), every, "cls")
    alone = rows.where("n_shingles = 0").withColumns({"class_id": F.col("doc_id"), "class_size": F.lit(1).cast("long"), "comp": F.lit(None).cast("long"), "component_id": F.col("doc_id"), "shared": F.lit(False)})
    return found.unionByName(alone.select(found.columns))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, hot_classes: int = HOT_CLASSES) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, class_id, class_size, component_id``.

    A set is the distinct k-word shingles of the whole text after lower-casing A-Z; a text of one to
    k-1 words is one shingle; a null or wordless text has none, links with nothing and is its own
    class and component.  Two rows link when ``100 * |intersection| >= percent * |union|``.
    ``class_id`` is the smallest id with an equal set and ``component_id`` the smallest id reachable
    by links; ids that are null count last, so a component of null ids only has a null id.  Rows that
    repeat an id are rows of their own.  Other columns are ignored; an empty table gives no rows.
    """
    return _classed(docs, id_col, text_col, k, percent, hot_classes).select("doc_id", "n_shingles", "class_id", "class_size", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their component: exactly one row of each.

    Rows are told apart by id and text, not by id.  Of a component the row with the smallest id stays
    (null last), of those that share that id the one whose id and text hash lowest, and of rows equal in
    id and text the least by their other columns.  Wordless rows are linked with nothing and all stay.
    """
    members = written(_classed(docs, id_col, text_col, k, percent, HOT_CLASSES).where("shared").select("comp", "doc_id", "rk"), "jaccard-rows")
    rank = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("doc_id"), F.col("rk").alias("rk"))
    first = members.groupBy("comp").agg(F.min(rank).alias("first"))
    chosen = written(first.select("first.doc_id", "first.rk", "comp"), "jaccard-chosen")
    # components of one row are not among these and stay; the others give their first row
    grouped = join_unique(members, chosen.select("comp", F.col("doc_id").alias("id0"), F.col("rk").alias("rk0")), "comp")
    goes = grouped.where(~(F.col("doc_id").eqNullSafe(F.col("id0")) & (F.col("rk") == F.col("rk0")))).select(F.col("doc_id").alias("gone_id"), "rk").distinct()
    repeated = members.groupBy("rk", "doc_id").agg(F.count("*").alias("held")).where("held > 1")
    kept = chosen.select(F.col("doc_id").alias("id0"), F.col("rk").alias("rk0"))
    twice = written(repeated.join(kept, (F.col("rk") == F.col("rk0")) & F.col("doc_id").eqNullSafe(F.col("id0")), "left_semi").select(F.col("doc_id").alias("gone_id"), "rk"), "jaccard-repeated")
    moved = written(goes.withColumn("goes", F.lit(True)).unionByName(twice.withColumn("goes", F.lit(False))), "jaccard-gone")
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    at = (key == moved["rk"]) & docs[id_col].eqNullSafe(moved["gone_id"])
    # texts are shuffled here at every size: what goes has no proven bound
    plain = docs.join(moved.hint("merge"), at, "left_anti").select(docs.columns)
    if twice.isEmpty():
        return plain
    # rows equal in id and text: one of them, summed up before the shuffle
    again = docs.join(moved.where("not goes"), at, "left_semi")
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    least = again.groupBy(id_col, text_col).agg(F.min(F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])).alias("least of the copies"))
    return plain.unionByName(least.select(id_col, text_col, *[F.col("least of the copies")[f"c{i}"].alias(c) for i, c in enumerate(others)]).select(docs.columns))
