"""Every registered query runs over its whole table; the pipeline's stages take effect."""

import os

import pytest

import corpus_pipeline
from simsift.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_a_row_for_every_row(spark, name):
    table = "embeddings" if name.startswith(("op3", "op11")) else "documents"
    each = 8 if name.startswith("op11") else 1  # a row for each component
    assert QUERIES[name](spark, SF).count() == each * spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, found = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    columns = sorted(df.columns)
    mine = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    assert mine == sorted(map(repr, (tuple(dict(zip(found.columns, r, strict=True))[c] for c in columns) for r in found.fetchall())))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert i + 1 == len(corpus_pipeline.STAGES) or out.columns == columns
        out.write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0 and counts[4] == counts[5] > 0
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))
    assert {r["n_tokens"] > 0 for r in docs.select("n_tokens").distinct().collect()} == {True}
