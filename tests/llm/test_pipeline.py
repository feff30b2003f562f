"""The pipeline against brute force, stage by stage, on a small fixture of planted cases."""

import collections
import random
import re

import pytest

pytest.importorskip("tesserae.llm")

import corpus_pipeline  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def fixture_dir(spark, tmp_path_factory):
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(300)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(f"b{i}", " ".join(f"item{i}x{j}" for j in range(20))) for i in range(3)]
    docs, labels = [], []
    base = prose(100)
    for i in range(200):
        w, toxic = prose(rng.randint(20, 80)), i % 8 == 0
        if toxic:
            w[3] = w[9] = "scum"
        elif i % 10 == 1:  # copies and near copies
            w = list(base)
            w[rng.randrange(100)] = rng.choice(vocabulary)
        elif i % 25 == 2:  # passages of the benchmark
            w[5:5] = items[i % 3][1].split()
        docs.append((i, " ".join(w), "en", None if i % 9 == 0 else f"s{i % 3}", 1))
        labels.append((i, 1, int(toxic)))
    docs += [(200, None, "en", "s1", 0), (201, "", "en", None, 0), (202, "one", None, "s2", 3), (203, docs[3][1], "en", "s0", 1)]
    where = str(tmp_path_factory.mktemp("pipeline"))
    for name, rows, schema in [("documents", docs, COLUMNS), ("benchmark", items, "item_id string, text string"), ("labels", labels, "doc_id long, quality int, toxic int")]:
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{where}/{name}.parquet")
    return where


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def _one_of_each(rows):
    sets = {}
    for r in rows:
        w = _words(r.text)
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    least = {d: d for d in sets}

    def find(d):
        while least[d] != d:
            d = least[d]
        return d

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    return {d for d in sets if find(d) == d}


def _clean(rows, items):
    kept = set()
    for r in rows:
        w, hit = _words(r.text), set()
        for _, t in items:
            x = t.split()
            for i in range(len(x) - 12):
                for j in range(len(w) - 12):
                    if w[j : j + 13] == x[i : i + 13]:
                        hit |= set(range(j, j + 13))
        if not hit or 20 * len(hit) < len(w):
            kept.add(r.doc_id)
    return kept


def test_stages(spark, fixture_dir):
    docs = corpus_pipeline.table(spark, fixture_dir, "documents")
    toxic = {r.doc_id for r in corpus_pipeline.table(spark, fixture_dir, "labels").where("toxic = 1").collect()}
    items = [tuple(r) for r in corpus_pipeline.table(spark, fixture_dir, "benchmark").collect()]
    wants = [
        lambda rows: {r.doc_id for r in rows} - toxic,
        _one_of_each,
        lambda rows: _clean(rows, items),
    ]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:3], wants, strict=True):
        rows = docs.collect()
        docs = corpus_pipeline.written(stage(spark, docs, fixture_dir), "test")
        kept = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert sorted(r.doc_id for r in kept) == sorted(want(rows)), name
        assert set(kept) <= set(rows), name

    before = {r.doc_id: r for r in docs.collect()}
    docs = corpus_pipeline.written(corpus_pipeline.STAGES[3][1](spark, docs, fixture_dir), "test")
    mixed = docs.collect()
    assert all(r == before[r.doc_id] for r in mixed)
    assert max(collections.Counter(r.doc_id for r in mixed).values()) <= 3
    size, taken = collections.Counter(), collections.Counter()
    for r in before.values():
        size[r.source] += len(_words(r.text))
    for r in mixed:
        taken[r.source] += len(_words(r.text))
    left, open_, target = float(sum(size.values())), dict(zip(sorted(size, key=lambda s: (s is None, s)), (5, 2, 1, 5), strict=True)), {}
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        full = [s for s in share if share[s] > 3 * size[s]]
        target |= {s: 3 * size[s] for s in full} or share
        left -= sum(3 * size[s] for s in full)
        open_ = {s: w for s, w in open_.items() if full and s not in full}
    longest = max(len(_words(r.text)) for r in before.values())
    assert all(abs(taken[s] - target[s]) <= longest for s in size), (taken, target)

    last = corpus_pipeline.STAGES[4][1](spark, docs, fixture_dir).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in mixed)
    shards = collections.defaultdict(list)
    for r in last:
        shards[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert max(map(len, shards.values())) - min(len(shards.get(s, [])) for s in range(24)) <= 1
    run = corpus_pipeline.run(spark, fixture_dir).collect()
    assert sorted(tuple(r) for r in run) == sorted(tuple(r) for r in last)
