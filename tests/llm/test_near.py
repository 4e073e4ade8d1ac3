"""Near-duplicates by SimHash probes against brute force over all pairs: recall by similarity, and no pair below it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from simsift.llm import simhash
from simsift.llm.components import Forest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sets(text, words=5):
    t = (text or "").lower().split()
    return {tuple(t[i : i + words]) for i in range(max(1, len(t) - words + 1))} if t else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, n, words):
    """Pairs of texts of n words in which some are replaced, of all similarities."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    other = list(base)
    for _ in range(words):
        other[rng.randrange(n)] = f"v{rng.randrange(10**6)}"
    return " ".join(base), " ".join(other)


@pytest.mark.parametrize("plan", [None, (3, 11), (8, 8)])
def test_recall_by_similarity(spark, monkeypatch, plan):
    """At least 0.9 of the pairs in every band from 0.8 on share a label, and none below 0.8 does: with the plan for so
    many rows, and with those for about 10^6 and 10^8 rows, which probe by several fingerprints."""
    if plan:
        monkeypatch.setattr(simhash, "reach", lambda *_: plan)
    rng, texts, bands = random.Random(4), [], {}
    for k in range(2400):
        n = rng.choice((60, 150, 400))
        texts += edited(rng, n, rng.randint(0, max(1, n // 35)))
        s = jaccard(sets(texts[-2]), sets(texts[-1]))
        bands.setdefault("below" if s < 0.8 else min(int(s * 20) / 20, 0.95), []).append(k)
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(4)
    label = {r["row"]: r["label"] for r in simhash.similar_labels(df).collect()}
    found = {b: np.mean([label[2 * k] == label[2 * k + 1] for k in ks]) for b, ks in bands.items()}
    print({b: (round(float(v), 3), len(bands[b])) for b, v in sorted(found.items(), key=str)})
    assert found.pop("below") == 0 and len(found) == 4
    assert all(len(bands[b]) > 100 and v >= 0.9 for b, v in found.items())
    assert len(set(label.values())) == len(texts) - sum(round(v * len(bands[b])) for b, v in found.items())


def rows():
    rng = random.Random(6)
    out = []
    for g in range(12):  # groups of near copies, of 2 to 40
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(120)]
        for _ in range(rng.choice((2, 5, 40))):
            t = list(base)
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(t))
    out += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 30))) for _ in range(60)]
    out += [None, "", " \t", "one", "One", "a b c", " ".join(f"long{i % 997}" for i in range(30_000)), out[0], out[0]]
    return [(i, t, "en", "s", 1) for i, t in enumerate(out)] + [(3, out[70], None, None, None), (None, out[71], None, None, None), (None, "alone among ids " * 3, None, None, None)]


def test_drop_near(spark):
    every = rows()
    s = [sets(r[1]) for r in every]
    forest = Forest(len(every))
    for i in range(len(every)):
        for j in range(i):
            if jaccard(s[i], s[j]) >= 0.8:
                forest.join(np.array([i]), np.array([j]))
    groups = {}
    for i, r in enumerate(forest.root(np.arange(len(every))).tolist()):
        groups.setdefault(r, []).append(i)
    expected = sorted(str(min((every[i][0] is None, every[i][0] or 0) for i in g)) for g in groups.values())
    df = spark.createDataFrame(every, SCHEMA).repartition(3).withColumns({n: F.lit(7) for n in ("fp", "node", "label", "row", "place", "_gone", "key")})
    kept = simhash.drop_near(df)
    assert kept.columns == df.columns
    found = sorted(str((r["doc_id"] is None, r["doc_id"] or 0)) for r in kept.collect())
    assert found == expected
    assert simhash.drop_near(df.limit(0)).count() == 0


def test_reach_grows_with_the_corpus():
    plans = [simhash.reach(n) for n in (10**3, 10**6, 10**9)]
    assert [p for p, _ in plans] == sorted(p for p, _ in plans) and plans[0][1] > plans[-1][1]
    p = simhash.differing(0.8)
    for probes, bits in plans:
        assert 1 - (1 - simhash._at_most(64, p, bits)) ** probes >= 0.95


def test_shared():
    rng = np.random.default_rng(1)
    found = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 1, 30, 30, 200, 0)]
    for k, common in simhash.shared(found):
        assert common.tolist() == [len(np.intersect1d(found[k], s)) for s in found]


def test_large_groups_are_dealt_to_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 8)
    monkeypatch.setattr(simhash, "PIVOTS", 2)
    test_drop_near(spark)


def test_hot_keys_of_several_probes(spark, monkeypatch):
    """Beyond about a million rows several fingerprints are probed, and keys become hot: fp is then one of the others too."""
    hot, dealt = [], simhash._hot
    monkeypatch.setattr(simhash, "HOT", 16)
    monkeypatch.setattr(simhash, "reach", lambda *_: (3, 11))
    monkeypatch.setattr(simhash, "_hot", lambda probes, bits: (hot.append((after := dealt(probes, bits)) is not probes), after)[1])
    test_drop_near(spark)
    assert hot.count(True) >= 3
