"""Rows made from one row of a file are told apart, license spans are bounded, and stages keep all columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from simsift.llm import exact, licenses, simhash, toxicity
from simsift.llm.common import numbered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stored_docs(spark, tmp_path_factory):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(6)]
    path = f"file://{tmp_path_factory.mktemp('places')}/docs"
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(2).write.parquet(path)
    return spark.read.parquet(path), path


def several(spark, df, path):
    twos = spark.createDataFrame([(1,), (2,)], "k int")
    yield "explode", df.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).drop("k")
    yield "join", df.join(twos, F.lit(True)).drop("k")
    yield "broadcast", df.join(F.broadcast(twos), df["doc_id"] >= twos["k"] - 100).drop("k")
    yield "union", df.union(df)
    yield "repartition", df.union(df).repartition(3)
    yield "paths", spark.read.parquet(path, path)
    yield "sample", df.sample(True, 2.0, 5).union(df)


def test_every_row_has_its_place(spark, stored_docs):
    df, path = stored_docs
    for name, made in several(spark, df.where("doc_id >= 0").select("doc_id", "text"), path):
        places = numbered(made, "row", "place")
        assert places.select("place").distinct().count() == places.count() == made.count(), name
    assert numbered(df, "row", "place").select("place").distinct().count() == 6


@pytest.mark.parametrize("heavy", [0.5, 0.02])
def test_one_of_each_stays(spark, stored_docs, monkeypatch, heavy):
    df, path = stored_docs
    monkeypatch.setattr(exact, "HEAVY", heavy)
    for name, made in several(spark, df, path):
        assert sorted(r["doc_id"] for r in exact.drop_exact(made).collect()) == list(range(6)), name
    hundred = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(100)))).drop("k")
    assert exact.drop_exact(hundred).count() == 6


def test_one_of_each_stays_near(spark, stored_docs):
    df, path = stored_docs
    for name, made in several(spark, df, path):
        if name in ("explode", "join", "repartition"):
            assert sorted(r["doc_id"] for r in simhash.drop_near(made).collect()) == list(range(6)), name


def test_sample_is_bounded(spark, stored_docs, monkeypatch):
    df, path = stored_docs
    monkeypatch.setattr(toxicity, "TOXIC", 5)
    monkeypatch.setattr(toxicity, "CLEAN", 7)
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    for name, made in several(spark, df, path):
        texts, toxic, _ = toxicity._sample(made, labels, F.lit(True), "doc_id", "text")
        assert len(texts) <= 12 and 0 < toxic.sum() <= 5, name


def plain_labels(text):
    """Labels of license texts that some stretch of words holds, by looking at every stretch."""
    w, out = licenses.words(text), set()
    for t in licenses.TEMPLATES:
        size = len(t.words)
        if t.phrase:
            if any(w[i : i + size] == t.words for i in range(len(w))):
                out.add(t.label)
            continue
        if any(w[i : i + size] == t.words for i in range(len(w) - size + 1)):
            out.add(t.label)
    return out


def test_no_complete_license_is_lost(spark):
    rng = random.Random(8)
    long = [t for t in licenses.TEMPLATES if not t.phrase]
    mit = licenses.TEMPLATES[3].text.split()
    texts = [" ".join(mit + (mit[-4:] + ["a", "b", "c", "d"]) * 49), " ".join((mit[:4] + ["a", "b", "c", "d"]) * 49 + mit), " ".join(mit + mit), " ".join(mit)]
    for _ in range(150):
        w = []
        for _ in range(rng.randint(1, 4)):
            t = rng.choice(long).text.split()
            for _ in range(rng.randint(0, 30)):
                at = rng.randrange(max(1, len(t) - 4))
                w += t[at : at + rng.randint(4, 9)] + [f"x{rng.randrange(99)}" for _ in range(rng.randint(0, 12))]
            w += rng.choice(long if rng.random() < 0.3 else [licenses.Template("", "", " ".join(t))]).text.split()
        texts.append(" ".join(w))
    found = {r["id"]: r for r in licenses.find_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        assert plain_labels(text) <= set(found[i]["labels"]), (text, found[i])
        for s in found[i]["spans"]:
            size = len(next(t for t in licenses.TEMPLATES if t.name == s["template"]).words)
            assert s["phrase"] or s["stop"] - s["start"] <= size / licenses.DENSE
    assert all(found[i]["labels"] == ["mit"] and found[i]["score"] == 1.0 for i in range(4))


def hard_rows():
    rng = random.Random(6)
    out = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)), "en", f"s{i % 2}", i) for i in range(30)]
    out += [(30, None, "en", "s0", 1), (31, "", None, None, None), (None, out[0][1], "en", None, 3), (None, None, None, None, None), out[1], out[1]]
    return out + [(40 + i, out[i][1] + " end", "en", "s1", 4) for i in range(3)]


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_on_hard_tables(spark, tmp_path, stage):
    """Nulls, repeated rows, empty tables and columns of any name: values of added columns come through unchanged."""
    labels = spark.createDataFrame([(i, 0, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    df = spark.createDataFrame(hard_rows(), SCHEMA)
    marked = df.withColumns({n: F.concat(F.lit(n), F.coalesce("text", F.lit("-"))) for n in ("score", "size", "copy", "copies", "kept", "row", "label", "rate", "Target", "keep_id", "predicted", "a`b")})
    run = corpus_pipeline.STAGES[stage][1]
    out = run(spark, marked, f"file://{tmp_path}")
    rows = out.collect()
    assert run(spark, marked.limit(0), f"file://{tmp_path}").count() == 0
    if stage == 4:
        assert len(rows) == len(hard_rows()) and {r["n_tokens"] for r in rows if r["doc_id"] in (30, 31)} == {0}
        return
    assert out.columns == marked.columns
    for r in rows:
        assert all(r[n] == n + (r["text"] if r["text"] is not None else "-") for n in marked.columns[5:])
    have = [(r["doc_id"], r["text"]) for r in rows]
    if stage == 0:
        assert len(have) == len(hard_rows())
    elif stage == 1:
        want = {}
        for i, t, *_ in hard_rows():
            want.setdefault(t or "", []).append((i is None, i or 0))
        assert sorted((t or "", i) for i, t in have) == sorted((t, min(v)[1] if not min(v)[0] else None) for t, v in want.items())
    elif stage == 2:
        assert sorted(i for i, _ in have) == [*range(31)]
    else:
        assert {i for i, _ in have} <= {r[0] for r in hard_rows()} and any(i == 30 for i, _ in have)
