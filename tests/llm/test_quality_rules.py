"""op10's ratio and threshold against plain Python, with more trusted texts than the 20,000 that once were all it read."""

import collections
import math
import random

import numpy as np
import pytest

from tesserae.llm import quality_rules


def _bucket(g: bytes) -> int:
    return (int.from_bytes(g, "little") * 0x9E3779B97F4A7C15 % (1 << 64)) >> 48


def test_every_trusted_text_counts(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "MOST_IDS", 9_000, raising=False)
    rng = random.Random(5)
    words = ["ash", "bee", "cog", "dew", "elm", "fig", "gum", "hay", "ivy", "jam", "kit", "log"]
    texts = [" ".join(rng.sample(words, 10)) for _ in range(21_000)] + [" ".join(rng.choice("#@!?") * 3 + str(i) for i in range(12)) for _ in range(300)]
    good = set(range(21_000))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(len(texts))] + [(3, None), (None, 1)], "doc_id long, quality int")
    grams = [[_bucket(b[j : j + 4]) for j in range(len(b) - 3)] for b in (t.encode() for t in texts)]
    target, raw = collections.Counter(), collections.Counter()
    for i, g in enumerate(grams):
        raw.update(g)
        if i in good:
            target.update(g)
    total = [sum(c.values()) + 0.5 * quality_rules.BUCKETS for c in (target, raw)]
    ratio = {b: math.log((target[b] + 0.5) / total[0]) - math.log((raw[b] + 0.5) / total[1]) for b in raw}
    llr = [sum(ratio[b] for b in g) / len(g) for g in grams]
    own = np.sort([llr[i] for i in good])
    least = own[int(len(own) * 0.001)] - 0.1 * own.std()
    rows = quality_rules.quality_rules(docs, labels).collect()
    assert len(rows) == len(texts)
    assert [r.llr for r in sorted(rows, key=lambda r: r.doc_id)] == pytest.approx(llr, abs=1e-9)
    assert {r.doc_id for r in rows if r.kept} == {i for i, s in enumerate(llr) if s >= least}
    assert 0 < sum(r.kept for r in rows) < len(rows)
