"""Document vectors: trained in blocks over all rows, inferred for any."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from simsift.operators import docvectors
from simsift.operators.docvectors import DocVectors, neighbour_share

SCHEMA = "id long, tokens array<string>"


def sentences(n, seed=2):
    rng = random.Random(seed)
    return [(i, [f"{'ab'[i % 2]}{rng.randrange(12)}" for _ in range(14)]) for i in range(n)]


def topics(df):
    return df.select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("topic"))


@pytest.mark.parametrize("blocks", [1, 3])
def test_topics_are_apart(spark, tmp_path, blocks):
    """Nearest neighbours share the topic in 0.9 of cases at least (0.5 by chance), fitted or inferred, in any number of blocks."""
    df = spark.createDataFrame(sentences(80), SCHEMA).repartition(3)
    model = DocVectors.fit(df, size=12, epochs=24, blocks=blocks)
    row = neighbour_share(model.fitted, topics(df), 4).first()
    assert row["queries"] == 20 and row["same"] >= 0.9 and 0.45 < row["chance"] < 0.55
    new = spark.createDataFrame([(100 + i, t) for i, t in sentences(24, 9)] + [(200, []), (201, None), (202, ["unknown"]), (203, sentences(24, 9)[0][1])], SCHEMA)
    found = model.vectors(new)
    assert neighbour_share(found.where("id < 200"), topics(new), 2).first()["same"] >= 0.9
    vec = {r["id"]: np.array(r["vec"]) for r in found.collect()}
    assert len(vec) == 28 and all(len(v) == 12 for v in vec.values()) and np.array_equal(vec[100], vec[203]) and np.array_equal(vec[200], vec[201])
    model.save(f"file://{tmp_path}/doc")
    again = {r["id"]: np.array(r["vec"]) for r in DocVectors.load(spark, f"file://{tmp_path}/doc").vectors(new.repartition(2)).collect()}
    assert all(np.array_equal(vec[i], again[i]) for i in vec)


def test_same_rows_same_vectors(spark):
    rows = [*sentences(20), (50, []), (51, None), sentences(20)[0]]
    fits = [sorted((r["id"], tuple(r["vec"])) for r in DocVectors.fit(spark.createDataFrame(rows, SCHEMA).repartition(1), size=4, epochs=2, blocks=2).fitted.collect()) for _ in range(2)]
    assert fits[0] == fits[1] and len(fits[0]) == 23
    assert DocVectors.fit(spark.createDataFrame([], SCHEMA), size=4, epochs=1).fitted.count() == 0


def test_jobs_do_not_grow_with_the_epochs_of_an_inference(spark, monkeypatch):
    """Where a task can hold all words; else each block of words takes its turns, over the same sentences."""
    df = spark.createDataFrame(sentences(60), SCHEMA).repartition(2)
    model = DocVectors.fit(df, size=12, epochs=12, blocks=1)
    longer = DocVectors(model.words, model.settings | {"epochs": 60})
    spark.sparkContext.setJobGroup("few-jobs", "")
    assert longer.vectors(df).count() == 60
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) < 40
    monkeypatch.setattr(docvectors, "HELD", 12 * 12)
    assert neighbour_share(model.vectors(df), topics(df), 4).first()["same"] >= 0.9


def test_steps_of_many_sentences():
    """A step adds up what its sentences would change alone; frequent words keep it small, others leave it large."""
    rng = np.random.default_rng(3)
    vectors, output, owner, at = rng.normal(size=(3, 4)), rng.normal(size=(6, 4)), np.array([0, 0, 2]), rng.integers(0, 6, (3, 4))
    new, out = vectors.copy(), output.copy()
    for o, places in zip(owner, at, strict=True):
        for k, p in enumerate(places):
            error = 0.1 * ((k == 0) - 1 / (1 + np.exp(-output[p] @ vectors[o])))
            new[o] += error * output[p]
            out[p] += error * vectors[o]
    docvectors._stepped(vectors, output, owner, at, 0.1, True)
    assert np.allclose(vectors, new) and np.allclose(output, out)
    assert docvectors._together(np.full(10, 1.0), 100_000, 5) > 1000
    assert docvectors._together(np.array([100_000.0, 2.0]) ** 0.75, 100_000, 5) < 10
    chance = rng.random(50) ** 4
    u = rng.random((400, 5))
    assert np.array_equal(docvectors.Drawn(chance)(u), np.searchsorted(np.cumsum(chance), u * chance.cumsum()[-1]))


def test_neighbours_against_all_pairs(spark):
    """More rows than a tile; of equal ones the smallest id is found, whatever the order of rows."""
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(3)], rng.choice("abc")) for i in range(700, 0, -1)]
    df = spark.createDataFrame(rows, "id long, vec array<float>, topic string").coalesce(1)
    x = {i: np.array(v) / max(np.linalg.norm(v), 1e-300) for i, v, _ in rows}
    topic = {i: t for i, _, t in rows}
    asked = [i for i in x if i % 20 == 0]
    best = [min((j for j in x if j != i), key=lambda j: (-round(float(x[i] @ x[j]), 9), j)) for i in asked]
    plain = np.mean([topic[i] == topic[j] for i, j in zip(asked, best, strict=True)])
    row = neighbour_share(df.select("id", "vec"), df.select("id", "topic")).first()
    assert row["queries"] == 35 and row["same"] == pytest.approx(plain)


def test_neighbours_of_all_titles(spark, tmp_path, monkeypatch):
    """The query asks for every title, in tiles of any size; a row alone has no neighbour."""
    from simsift.plans.catalogue import QUERIES

    rng = random.Random(5)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{rng.randrange(9)}" for _ in range(12)), "ab"[i % 2]) for i in range(1, 60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert QUERIES["doc_vector_neighbours"](spark, f"file://{tmp_path}").first()["queries"] == 59
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)], rng.choice("abc")) for i in range(500)], "id long, vec array<double>, topic string")
    x = np.array([r["vec"] for r in df.orderBy("id").collect()])
    topic = [r["topic"] for r in df.orderBy("id").collect()]
    x /= np.linalg.norm(x, axis=1)[:, None]
    cosine = x @ x.T
    np.fill_diagonal(cosine, -2)
    plain = np.mean([topic[i] == topic[j] for i, j in enumerate(cosine.argmax(axis=1))])
    for numbers in (1 << 21, 400):  # 5 blocks of queries
        monkeypatch.setattr(docvectors, "ASKED", numbers)
        monkeypatch.setattr(docvectors, "TILE", 64)
        row = neighbour_share(df.select("id", "vec"), df.select("id", "topic"), 1).first()
        assert row["queries"] == 500 and row["same"] == pytest.approx(plain)
    assert neighbour_share(df.select("id", "vec").where("id = 1"), df.select("id", "topic"), 1).first()["queries"] == 0
