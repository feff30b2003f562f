"""The corpus operators against brute force on small tables with nulls, copies, ties and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tesserae.llm")

from pyspark.sql import functions as F  # noqa: E402

from tesserae.llm import decontaminate, jaccard_join, language_model, line_dedup, mixing, quality_classifier, quality_rules, secrets, sharding, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, w string, key long, cls string"


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "straße", "idiot"]
    out = []
    for _ in range(30):
        out.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))))
    base = [rng.choice(vocabulary) for _ in range(80)]
    for _ in range(25):  # near copies of one text
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(80)] = rng.choice(vocabulary)
        out.append(" ".join(w))
    out += [None, "", "   \n", "One", "one", "a b c", "A  B\tC", " ".join(base).upper(), "x " * 3000]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", 1, 2, "x", 3, "y") for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s1", 1, 2, "x", 3, "y"), (None, texts[6], "en", "s1", 1, 2, "x", 3, "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jaccard_join(docs, empty, texts):
    def members(t):
        w = _words(_lower(t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    every = [*enumerate(texts), (5, texts[5]), (None, texts[6])]
    sets = [members(t) for _, t in every]
    comp = list(range(len(every)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(every)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                comp[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(every):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = collections.Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(every))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs).collect())
    assert got == want
    assert jaccard_join.jaccard_join(empty).count() == 0
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None} == set(least.values())


def test_one_row_of_each(spark):
    """Rows that repeat an id or have none: one of each text stays, and no other text goes."""
    a, b, c = "a b c d e f g", "h i j k l m n", "only here"
    rows = [(1, a, 1), (3, a, 2), (3, b, 3), (7, b, 4), (9, c, 5), (None, c, 6), (None, None, 7), (4, "", 8), (4, "", 9), (5, "q r s t u v", 10), (5, "q r s t u v", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `0` int")
    kept = jaccard_join.one_of_each(df).collect()
    assert sorted((r.text or "" for r in kept)) == sorted(["", "", "", a, b, c, "q r s t u v"])
    assert {(1, a), (3, b), (9, c), (5, "q r s t u v")} <= {(r.doc_id, r.text) for r in kept}


def test_jaccard_hot_shingles(docs, monkeypatch):
    """Shingles named apart because many texts hold them change nothing."""
    want = sorted(map(str, jaccard_join.jaccard_join(docs).collect()))
    monkeypatch.setattr(jaccard_join, "HOT_SAMPLE", 1)
    assert len(jaccard_join.hot_shingles(docs, "text", 5, 3))
    assert sorted(map(str, jaccard_join.jaccard_join(docs, hot_classes=3).collect())) == want


@pytest.mark.parametrize("limit", [500_000, 0])
def test_decontamination(spark, docs, empty, texts, limit):
    w = _words(texts[31])
    items = [(1, " ".join(w[:20])), (2, " ".join(w[10:16])), (3, "one"), (4, None), (5, "not there at all, or is it: really no such text in any of these documents"), (5, "a b c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t))
    windows = collections.defaultdict(set)
    for i, t in items:
        x = cut(t)
        n = min(13, len(x))
        for a in range(len(x) - n + 1 if n else 0):
            windows[tuple(x[a : a + n])].add(str(i))
    want = collections.Counter()
    for d, t in [*enumerate(texts), (5, texts[5]), (None, texts[6])]:
        x, hit, found = cut(t), set(), set()
        for k, who in windows.items():
            for a in range(len(x) - len(k) + 1):
                if tuple(x[a : a + len(k)]) == k:
                    hit |= set(range(a, a + len(k)))
                    found |= who
        want[(d, len(x), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(x))] += 1
    got = decontaminate.contamination(docs, bench, broadcast_rows=limit).drop("rk").collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_sharding(docs, empty):
    rows = sharding.shard(docs).collect()
    n = len(rows)
    assert sorted(r.slot * 24 + r.shard for r in rows) == list(range(n))
    assert all(sharding.permuted(r.number, n) == r.slot * 24 + r.shard for r in rows)
    assert sharding.shard(empty).count() == 0
    for m in (1, 2, 3, 10, 1000):
        assert sorted(sharding.permuted(x, m) for x in range(m)) == list(range(m))


def test_mixing(docs, empty, texts):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert r.size * math.floor(r.target / max(r.source_size, 1)) <= r.taken <= 3 * r.size
    total = sum(r.size for r in rows)
    assert sum(v[0].target for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert v[0].source_size == sum(r.size for r in v)
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r.size for r in v)
        assert v[0].target <= 3 * v[0].source_size + 1e-6
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.rk, r.taken) for r in rows) == sorted((r.rk, r.taken) for r in again)
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def test_many_equal_rows(spark):
    """Nine rows of ten are the same: shards stay level, the mix stays near its target, and each row has its own turn."""
    rows = [(None, "the same few words", "a")] * 900 + [(i, f"word {i} # | #", "b") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    dealt = sharding.shard(df).collect()
    assert sorted(r.number for r in dealt) == list(range(1000))
    assert sorted(r.slot * 24 + r.shard for r in dealt) == list(range(1000))
    mix = mixing.mix(df, edge_rows=2).collect()
    assert len(mix) == 1000
    for s in "ab":
        own = [r for r in mix if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    again = mixing.mix(df, quality=F.lit(0.001), edge_rows=2).collect()
    assert abs(sum(r.taken for r in again if r.source == "b") - sum(r.taken for r in mix if r.source == "b")) <= 6
    assert mixing.mixed(df).count() == sum(r.copies for r in mix)


def test_secrets(spark, empty):
    key = "AKIA" + "Q7" * 10
    cases = [f"é password = 'hunter22' {key} x", "secret=token:abcdef api_key: abc", "deadbeef" * 4, "AKIA123", None, "", f"\U0001f600token:zz99zz {'0' * 30}", "q8ZkP3vLx9TbR2mNc7WdY5sH"]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    pats = [("assign", secrets.ASSIGN, lambda m: len(m[2]) >= 6), ("access", secrets.ACCESS, lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    for i, t in enumerate(cases):
        base = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(pats) for m in re.finditer(p, t or "") if ok(m))
        text = ",".join(f"{pats[k][0]}:{a}:{b}" for a, k, b in base)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (t, got[i].spans)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
    assert got[7].spans == "entropy:0:24"
    assert got[0].n_entropy == 0
    assert secrets.scan(empty).count() == 0
    s = "q8ZkP3vLx9TbR2mNc7WdY5sHq8q8q8q8q8q8"
    best = max(-sum(c / 20 * math.log2(c / 20) for c in collections.Counter(s[i : i + 20]).values()) for i in range(len(s) - 19))
    assert spark.range(1).select(secrets.peak_entropy(F.lit(s))).first()[0] == pytest.approx(best)


def _entropy_spans(text):
    """The entropy scan of a text without base spans, window by window."""
    uuid, words = re.compile(secrets.UUID), re.compile("|".join(f"(?:{p})" for p in secrets.SEGMENTS.split("|", 3)[:3]))
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        pieces, piece = [], ""
        for part in re.split(r"([/_=-]| )", uuid.sub(" ", m[0])):
            placeholder = re.search("example|sample|dummy|placeholder|changeme", part, re.IGNORECASE)
            if part == " " or words.fullmatch(part) or placeholder:
                pieces.append(piece)
                piece = ""
            else:
                piece += part
        for p in [*pieces, piece]:
            p = p.strip("/_=-")
            for i in range(len(p) - 19):
                w = p[i : i + 20]
                bits = -sum(c / 20 * math.log2(c / 20) for c in collections.Counter(w).values())
                if bits >= next(b for _, k, b in secrets.CLASS_BITS if re.search(k, w)):
                    out.append(f"entropy:{m.start()}:{m.end()}")
                    break
            else:
                continue
            break
    return ",".join(out)


def test_secret_entropy(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds = [letters, letters[:26], letters + "0123456789", letters + "0123456789+/", "0123456789abcdef", "ab"]
    cases = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            chars = rng.choice(kinds)
            parts.append(rng.choice(["report", "2024", "Example", "ACME", "123e4567-e89b-12d3-a456-426614174000", "".join(rng.choice(chars) for _ in range(rng.randint(5, 60)))]))
        cases.append("é " + rng.choice(["/", "-", "_", " "]).join(parts))
    cases = [c for c in cases if not re.search("[0-9a-f]{24}|AKIA", c)]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.scan(df).collect()}
    assert [got[i] for i in range(len(cases))] == [_entropy_spans(c) for c in cases]
    assert sum(bool(x) for x in got.values()) > 20


def test_secrets_of_long_texts(spark):
    """Very long paths, runs and lists of matches, and digits beyond any look-ahead."""
    rng = random.Random(9)
    key = "q8ZkP3vLx9TbR2mNc7WdY5sH"
    run = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(60))
    cases = ["1" + "/a" * 20_000, "path/" * 16 + key, run, "A" * (1 << 20), "token=abcdef " * 3000 + key, "my_example_key_" + key]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: (r.n_assign, r.n_entropy) for r in secrets.scan(df).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (0, 1), 3: (0, 0), 4: (3000, 1), 5: (0, 1)}


def _within_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _near_line(w, o):
    """One word of eight or more words, or one character but no digit of eight or more characters."""
    if min(len(w), len(o)) >= 8:
        return _within_one(w, o)
    a, b = " ".join(w), " ".join(o)
    if max(len(w), len(o)) >= 8 or min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        apart = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
        return len(apart) == 1 and not any(c in "0123456789" for c in apart[0])
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a and b[i] not in "0123456789" for i in range(len(b)))


@pytest.mark.parametrize("limit", [500_000, 0])
def test_line_dedup(spark, empty, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", limit)
    rng = random.Random(2)
    base = [[f"v{rng.randrange(50)}" for _ in range(rng.randint(8, 14))] for _ in range(6)]
    docs = []
    for d in range(25):
        lines = []
        for _ in range(rng.randint(1, 4)):
            w = list(rng.choice(base))
            what = rng.randrange(5)
            if what == 0:
                w[rng.randrange(len(w))] = "new"
            elif what == 1:
                del w[rng.randrange(len(w))]
            elif what == 2:
                w.insert(rng.randrange(len(w)), f"u{rng.randrange(3)}")
            elif what == 3:
                w = w[:3]
            lines.append("  ".join(w).upper() if what == 4 else " ".join(w))
        lines.append(rng.choice(["chapter one", "chapter onee", "chaptar one", "Chapter  1 on", "chapter 2 on", "ab", "ac", "", "grüße an alle"]))
        docs.append((d, "\n".join(lines) + rng.choice(["", "\n", "\n\n"])))
    df = spark.createDataFrame([*docs, (99, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
    seen = []
    for d, t in [*docs, (99, None)]:
        dropped = []
        for i, line in enumerate((t or "").split("\n")):
            w = _lower(line).split()
            if w and any(w == o or _near_line(w, o) for o in seen):
                dropped.append(str(i))
            if w:
                seen.append(w)
        assert got[d].dropped == ",".join(dropped), d
        assert got[d].n_lines == (t or "").count("\n") + 1
    assert line_dedup.line_dedup(empty).count() == 0
    assert line_dedup.without_duplicate_lines(df).count() == 26


def test_quality_rules(spark, docs, empty, texts):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    extra = ["p q r s t\nz\np q r s t\n\n z\nz", "# a | b <c>"]
    more = docs.unionByName(spark.createDataFrame([(200 + i, t, "", "", 0, 0, "", 0, "") for i, t in enumerate(extra)], SCHEMA))
    every = [*enumerate(texts), (5, texts[5]), (None, texts[6]), *((200 + i, t) for i, t in enumerate(extra))]
    want = collections.Counter()
    for d, t in every:
        t = t or ""
        w = _words(t)
        at = collections.defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        repeat = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(5)}
        lines = [x for x in t.split("\n") if _words(x)]
        want[(d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat), len(w) < 10 or 100 * len(repeat) > 20 * len(w))] += 1
    rows = quality_rules.quality_rules(more, labels).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert not any(r.kept for r in rows if r.base_failed)
    assert quality_rules.quality_rules(empty, labels).count() == 0


def test_language_model(docs, empty, texts):
    out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    rows = language_model.log_likelihood(docs, out).collect()
    every = [*enumerate(texts), (5, texts[5]), (None, texts[6])]
    c = collections.Counter()
    for d, t in every:
        if d is not None and zlib.crc32(str(d).encode()) % 10:
            c.update([*_words(_lower(t)), "\n"])
    n, v = sum(c.values()), len(c)
    want = sorted((d if d is not None else -1, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*_words(_lower(t)), "\n"]), 6), sum(c[w] > 0 for w in [*_words(_lower(t)), "\n"])) for d, t in every)
    assert sorted((r.doc_id if r.doc_id is not None else -1, round(r.base_score, 6), r.n_known) for r in rows) == want
    assert all(r.train_tokens == n and r.score < 0 for r in rows)
    assert language_model.log_likelihood(empty, out).count() == 0


def test_language_model_scores_like_a_slow_one(spark, docs, texts, monkeypatch):
    """The score against one state and one word at a time, from the trained weights."""
    seen, plain = [], language_model.flat
    monkeypatch.setattr(language_model, "flat", lambda net: seen.append(net) or plain(net))
    out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    rows = {r.doc_id: r.score for r in language_model.log_likelihood(docs, out).collect() if r.doc_id not in (None, 5)}
    net = {k: v.astype(float) for k, v in seen[-1].items()}
    every = [*enumerate(texts), (5, texts[5])]
    c = collections.Counter(w for d, t in every if zlib.crc32(str(d).encode()) % 10 for w in _words(_lower(t)))
    def hashed(w):
        data = np.frombuffer(w.encode(), np.uint8)
        return int(language_model.K.word_hashes(data, language_model.K.Words(data, np.array([0, len(data)])))[0])

    order = sorted(c, key=lambda w: (-c[w], hashed(w)))[: language_model.VOCABULARY]
    number = {w: i + 2 for i, w in enumerate(order)}
    rest = sum(c.values()) - sum(c[w] for w in order) + 0.1 * (len(c) - len(order) + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    n = language_model.HIDDEN
    for d, t in list(enumerate(texts))[::6]:
        if d == 5:
            continue
        h, x, total = np.zeros(n), language_model.END, 0.0
        for w in [*_words(_lower(t)), None][:400]:
            a = net["x"][x] + net["g"]
            zr = sigmoid(a[: 2 * n] + h @ net["u"])
            new = np.tanh(a[2 * n :] + (zr[n:] * h) @ net["c"])
            h = h + zr[:n] * (new - h)
            y = language_model.END if w is None else number.get(w, language_model.UNKNOWN)
            k, inner = divmod(y, language_model.PER_CLASS)
            own = slice(k * language_model.PER_CLASS, (k + 1) * language_model.PER_CLASS)
            for v, i in ((h @ net["wc"] + net["bc"], k), (net["wo"][own] @ h + net["bo"][own], inner)):
                total += v[i] - np.log(np.exp(v).sum())
            if y == language_model.UNKNOWN:
                total += math.log((c[w] + 0.1) / rest)
            x = y
        if len(_words(t)) < 400:
            assert rows[d] == pytest.approx(total / math.log(10), rel=1e-4), d


def test_language_model_trains_on_every_word(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([t or "" for t in texts])], names=["key", "txt"])
    net = language_model.start_net(np.ones(language_model._SIZE))
    vocabulary = (np.empty(0, np.uint64), np.empty(0, np.int64))
    assert language_model._train(net, iter([batch]), vocabulary) == sum(len(_words(t)) + 1 for t in texts)


def test_classifiers(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        bad, toxic = i % 5 == 0, i % 4 == 0
        w = [f"word{rng.randrange(200)}" + ("###" if bad else "") for _ in range(rng.randint(12, 60))]
        if toxic:
            w[3] = w[8] = "scum"
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs, lab, keep=lambda i: i % 3 != 1)
    got = {r.doc_id: r for r in quality_classifier.score(docs, model).collect()}
    assert sum(got[i].predicted == q for i, q, _ in labels if i % 3 == 1) >= 97
    assert all(0 <= r.score <= 1 for r in got.values())
    tox = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, lab)).collect()}
    assert all(tox[i].toxic == bool(t) for i, _, t in labels)
    assert 0 <= tox[900].severity < 1 and not tox[901].toxic
    assert toxicity.without_toxic(docs, lab.limit(0)).count() == docs.count()
