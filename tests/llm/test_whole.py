"""Whitening, runs of words and repeated windows against brute force, on hard tables."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from simsift.llm import recompress, runs, whitening

TEXTS = "doc_id long, text string"


def clash(df, *names):
    return df.withColumns({n: F.lit(7) for n in names})


# -- 11 ------------------------------------------------------------------------------------------


def vectors(rng, n=60, dim=5):
    x = rng.normal(size=(n, dim)) * [3, 1, 0.5, 0.1, 0.02][:dim] + 2
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


BAD = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [float("nan")] * 5), (903, [1.0, float("inf"), 0.0, 0.0, 0.0]), (904, [])]


def exact_deviations(rows):
    x = [[(Fraction(c) * 1024).__floor__() + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    return x, n, sums, [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]


@pytest.mark.parametrize("kind", ["double", "float"])
def test_whitening(spark, kind):
    rows = vectors(np.random.default_rng(1))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    rows += [rows[3], rows[3], (None, rows[5][1])]  # repeated rows count as often as they occur
    df = spark.createDataFrame(rows + BAD, f"vec_id long, embedding array<{kind}>").repartition(4)
    found = whitening.whiten(clash(df, "n", "row", "vector", "Whitened"), components=3)
    assert found.columns == ["vec_id", "embedding", "row", "vector", *whitening.ADDED] and {r["row"] for r in found.select("row").collect()} == {7}
    got = found.collect()
    x, n, sums, deviation = exact_deviations(rows)
    assert len(got) == len(rows) and sorted(int(r["deviation_text"]) for r in got) == sorted(r["deviation"] for r in got) == sorted(deviation)
    z = np.array([[float(Fraction(a) - Fraction(s, n)) for a, s in zip(v, sums, strict=True)] for v in x])
    e, u = np.linalg.eigh(z.T @ z / n)
    white = {i: w for (i, _), w in zip(rows, z @ u[:, ::-1][:, :3] / np.sqrt(e[::-1][:3]), strict=True)}
    sign = np.sign(np.array(next(r["whitened"] for r in got if r["vec_id"] == 0)) * white[0])
    assert all(np.allclose(np.array(r["whitened"]) * sign, white[r["vec_id"]], atol=1e-9) and r["n"] == n for r in got)
    assert np.allclose(got[0]["explained"], e[::-1][:3] / e.sum(), rtol=1e-9) and got[0]["identity_error"] < 1e-9
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id >= 900")).count() == 0


def test_whitening_of_huge_and_flat(spark):
    """Sums beyond any machine number are exact; components without variance have no whitened value; lengths are fits of their own."""
    rng = random.Random(3)
    big = [(i, [rng.choice((-1, 1)) * 2.0 ** rng.randint(20, 50), rng.random(), 4.0]) for i in range(40)] + [(50, [1e300, 0.0, 4.0]), (60, [1.0]), (61, [1.0])]
    got = whitening.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>").repartition(3)).collect()
    x = [[max(-whitening.MOST, min(whitening.MOST, (Fraction(c) * 1024).__floor__() + 100_000)) for c in v] for _, v in big[:41]]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    expected = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for (i, _), v in zip(big, x, strict=False)}
    assert all(int(r["deviation_text"]) == expected[r["vec_id"]] for r in got if r["vec_id"] < 60)
    assert all(r["deviation"] is None for r in got if r["vec_id"] < 60) and all(r["whitened"][2] is None for r in got if r["vec_id"] < 60)
    assert all(r["n"] == 2 and r["whitened"] == [None] and r["deviation"] == 0 and r["explained"] == [None] for r in got if r["vec_id"] >= 60)


def test_cross_products_are_exact():
    rng = np.random.default_rng(2)
    y = rng.integers(-(1 << 60), 1 << 60, (5000, 3))
    expected = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(3)] for i in range(3)]
    assert whitening.cross(y).tolist() == expected
    back = sum(p.astype(np.int64).astype(object) * (1 << 20 * k) for k, p in enumerate(whitening.limbs(y)))
    assert (back.astype(np.int64) == y).all()


# -- 12 ------------------------------------------------------------------------------------------


def brute_runs(w, exponent=4, least=6):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, exponent * q) and not any(all(w[i + k] == w[i + k + p] for k in range(length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng):
    letters, w = "abcdef"[: rng.choice((1, 2, 3, 6))], []
    for _ in range(rng.randint(0, 6)):
        part = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
        w += part * rng.randint(1, 9) + part[: rng.randint(0, len(part))] if rng.random() < 0.6 else part
    return w


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (3, 4), (2, 2)])
def test_runs_against_brute_force(exponent, least):
    rng = random.Random(exponent)
    for _ in range(150):
        texts = [[x.encode() for x in periodic(rng)] for _ in range(rng.randint(1, 5))]
        words, limit, begin = runs._numbers(texts, exponent)
        start, length, period = runs.runs(words, limit, exponent, least)
        found = [[] for _ in texts]
        for s, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True):
            t = int(np.searchsorted(begin, s, side="right")) - 1
            found[t].append((s - int(begin[t]), n, q))
        assert found == [brute_runs(t, exponent, least) for t in texts]


def test_long_periods_in_one_text():
    rng = random.Random(4)
    part = [b"%d" % rng.randrange(10**6) for _ in range(3000)]
    words, limit, _ = runs._numbers([[b"x", b"y", *part * 4, *part[:100], b"z"]], 4)
    assert [v.tolist() for v in runs.runs(words, limit)] == [[2], [12_100], [3000]]


def test_runs_of_hard_tables(spark, monkeypatch):
    monkeypatch.setattr(runs, "BATCH", 200)
    rng = random.Random(6)
    rows = [(i, " ".join(periodic(rng))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "a\tb\x0bc " * 9), (104, "é x " * 7), (None, "r " * 8), rows[1], rows[1], (105, " ".join(f"u{i}" for i in range(30_000)))]
    df = spark.createDataFrame(rows, TEXTS).repartition(3)
    found = runs.find_runs(clash(df, "runs", "row", "collapsed", "N_words")).collect()
    assert len(found) == len(rows)
    for r in found:
        w = (r["text"] or "").encode().split()
        expected = brute_runs(w) if len(w) < 2000 else []
        assert [tuple(x) for x in r["runs"]] == expected and r["n_words"] == len(w)
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in expected)]
        assert r["collapsed"].encode() == b" ".join(kept) and r["row"] == 7
    assert runs.find_runs(df.limit(0)).count() == 0


def test_runs_query(spark, tmp_path):
    """The query's planted repeats and its digest columns, computed again in plain Python."""
    import zlib

    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randint(0, 80)))) for i in range(120)] + [(500, None), (501, "  ")]
    spark.createDataFrame(rows, TEXTS).write.parquet(f"file://{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in runs.runs_query(spark, f"file://{tmp_path}").collect()}
    for i, text in rows:
        w = (text or "").split()
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        expected, r = brute_runs(w), found[i]
        best = min(expected, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(expected), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if expected else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in expected).encode()).hexdigest()
        kept = [x for k, x in enumerate(w) if not any(s + q <= k < s + m for s, m, q in expected)]
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    assert any(r["n_runs"] for r in found.values())


# -- 13 ------------------------------------------------------------------------------------------


def brute_cuts(rows, window):
    """Removed words of each row, by looking every window up; rows in order of id, null ids last."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = (text or "").encode().split()
        cut = [False] * len(w)
        for s in range(len(w) - window + 1):
            part = tuple(w[s : s + window])
            if part in seen:
                cut[s : s + window] = [True] * window
            seen.add(part)
        out.append((i, len(w), sum(cut), b" ".join(x for x, c in zip(w, cut, strict=True) if not c).decode()))
    return out


def passages(rng, n):
    base = [[rng.choice("abcde") if rng.random() < 0.5 else f"w{rng.randrange(300)}" for _ in range(rng.randint(20, 60))] for _ in range(12)]
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 6)):
            kind, part = rng.random(), rng.choice(base)
            if kind < 0.5:
                at = rng.randrange(len(part))
                w += part[at : at + rng.randint(1, 50)]
            elif kind < 0.7:
                w += [rng.choice("ab")] * rng.randint(1, 60)
            elif kind < 0.8:
                w += (["p", "q", "r"] * 30)[: rng.randint(1, 80)]
            else:
                w += [f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 40))]
        yield i, " ".join(w)


@pytest.mark.parametrize("window", [20, 8, 1])
def test_repeats_against_brute_force(spark, monkeypatch, window):
    monkeypatch.setattr(recompress, "BLOCK", 16)
    monkeypatch.setattr(recompress, "OWN", 800)
    monkeypatch.setattr(recompress, "PARSED", 3000)
    rows = list(passages(random.Random(3), 300))
    rows += [(600 + k, rows[k][1]) for k in range(30)] + [(700, None), (701, ""), (702, "\t\n "), (None, rows[4][1] + " " + rows[5][1])]
    df = clash(spark.createDataFrame(rows, TEXTS).repartition(5), "id", "block", "at", "kept")
    found = recompress.cut_repeats(df, window=window).collect()
    told = sorted(((r["id"], r["n_words"], r["n_removed"], r["kept"]) for r in found), key=str)
    assert told == sorted(brute_cuts(rows, window), key=str)
    for r in found:
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert all(a["stop"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False)) or not r["spans"]
    assert recompress.cut_repeats(df.limit(0)).count() == 0


def test_repeated_rows_and_long_texts(spark, tmp_path):
    """Of rows with one id one is first; behind a union as well as in files; a long text repeats itself."""
    text, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    long = " ".join(f"v{i % 30_000}" for i in range(45_000))
    rows = [(1, text), (1, text), (1, text), (2, f"{other} {text}"), (3, long), (0, other[: other.index(" y30")])]
    df = spark.createDataFrame(rows, TEXTS)
    df.write.parquet(f"file://{tmp_path}/docs")
    for made in (df.repartition(3), spark.read.parquet(f"file://{tmp_path}/docs"), spark.read.parquet(f"file://{tmp_path}/docs").withColumn("k", F.explode(F.array(F.lit(1))))):
        found = sorted((r["id"], r["n_words"], r["n_removed"]) for r in recompress.cut_repeats(made).collect())
        assert found == [(0, 30, 0), (1, 40, 0), (1, 40, 40), (1, 40, 40), (2, 80, 70), (3, 45_000, 15_000)]


def test_equal_passages_have_equal_symbols():
    """Inside a passage symbols hang on the passage alone: every window of two places of it holds the same marks."""
    rng = random.Random(5)
    hashes = recompress._Words()
    for _ in range(40):
        part = [rng.choice((b"a", b"b", b"%d" % rng.randrange(50))) for _ in range(60)]
        texts = [[b"%d" % rng.randrange(50) for _ in range(rng.randint(0, 9))] + part + [b"%d" % rng.randrange(50) for _ in range(rng.randint(0, 9))] for _ in range(2)]
        parse = recompress.Parse(texts, hashes)
        name, low, high = parse.marks(20)
        sets = []
        for t in range(2):
            begin = int(parse.begin[t]) + next(i for i in range(len(texts[t]) - 59) if texts[t][i : i + 60] == part)
            inside = (low >= begin) & (high <= begin + 60)
            sets.append(list(zip((low[inside] - begin).tolist(), (high[inside] - begin).tolist(), name[inside].tolist(), strict=True)))
        assert sets[0] == sets[1]
    one, two = recompress.Parse([part, part, part[:-1]], hashes).names()
    assert one[0] == one[1] != one[2] and two[0] == two[1] != two[2]
