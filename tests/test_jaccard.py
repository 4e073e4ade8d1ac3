"""Exact Jaccard joins and searches, frequent keys in tiles, signatures as aggregates, and streams of answers."""

import random

import pytest
from pyspark.sql import functions as F

from simsift.functions import features as ft
from simsift.functions import hashing
from simsift.operators import encode as enc
from simsift.operators import evaluate as ev
from simsift.operators import jaccard
from simsift.operators.minhash import MinHash, MinHashIndex
from simsift.sources import posts, sinks
from simsift.streaming import ingest

SCHEMA = "id int, tokens array<string>"


def items(n=150, seed=1):
    rng = random.Random(seed)
    out = [(i, [f"w{min(int(rng.expovariate(0.15)), 30)}" for _ in range(rng.randint(1, 9))]) for i in range(n)]
    return [*out, (n, []), (n + 1, None), (n + 2, out[0][1][::-1] * 2)]


def similarity(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


@pytest.mark.parametrize(("tile", "threshold"), [(2000, 0.5), (3, 0.5), (4, 0.8)])
def test_jaccard(spark, monkeypatch, tile, threshold):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = items()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    sets = {i: frozenset(t) for i, t in rows if t}
    class_ = {i: min(j for j, u in sets.items() if u == s) for i, s in sets.items()}
    pairs, members = jaccard.jaccard_pairs(df, threshold)
    assert {(r["id"], r["class"]) for r in members.collect()} == set(class_.items())
    wanted = {(a, b) for a in set(class_.values()) for b in set(class_.values()) if a < b and similarity(sets[a], sets[b]) >= threshold - 1e-12}
    found = pairs.collect()
    assert {(r["a"], r["b"]) for r in found} == wanted and len(found) == len(wanted)
    asked = spark.createDataFrame([(i, t) for i, t in rows if i % 4 == 0] + [(900, ["w1", "never"])], SCHEMA)
    best = {(q, i, p) for q, t in [(r["id"], r["tokens"]) for r in asked.collect()] if t for p, (_, i) in enumerate(sorted((-similarity(t, u), i) for i, u in sets.items() if similarity(t, u) >= threshold - 1e-12)[:5], 1)}
    assert {(r["query"], r["id"], r["place"]) for r in jaccard.jaccard_topk(df, asked, threshold, 5).collect()} == best


def test_frequent_key_in_tiles(spark, monkeypatch):
    """A key with many rows is spread over cells of bounded size; pairs and joins are as without tiles."""
    rows = spark.range(60).select("id", F.lit("hot").alias("key")).union(spark.range(60, 64).select("id", F.lit("rare").alias("key")))
    whole = sorted(map(tuple, jaccard.tiled_pairs(rows, ["key"], "id").collect()))
    monkeypatch.setattr(jaccard, "TILE", 7)
    assert sorted(map(tuple, jaccard.tiled_pairs(rows, ["key"], "id").collect())) == whole and len(whole) == 60 * 59 // 2 + 6
    dealt = jaccard._dealt(rows, jaccard._tiles(rows, ["key"]), ["key"], F.col("id")).groupBy("key", "tile").count().collect()
    assert max(r["count"] for r in dealt if r["key"] == "hot") <= 3 * 7 and len([r for r in dealt if r["key"] == "hot"]) >= 7
    asked = spark.createDataFrame([(1, "hot"), (2, "rare"), (3, "none")], "q int, key string")
    assert sorted((r["q"], r["id"]) for r in jaccard.tiled_join(asked, rows, ["key"], "id").collect()) == [(1, i) for i in range(60)] + [(2, i) for i in range(60, 64)]


def test_recall_of_bands(spark):
    """The index finds nearly all that is as similar as its threshold asks for, and all candidates agree with tiles."""
    rng = random.Random(4)
    base = [[f"b{i}x{j}" for j in range(12)] for i in range(40)]
    rows = [(i, base[i // 4][: 12 - rng.randint(0, 3)]) for i in range(160)]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = df.where("id % 4 = 0")
    exact = {(r["query"], r["id"]) for r in jaccard.jaccard_topk(df, asked, 0.7, 10).collect()}
    found = {(r["query"], r["id"]) for r in MinHashIndex.build(df).search(asked, 10).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_signatures_of_rows(spark, tmp_path):
    """Tokens of an item in several rows, partitions and batches give the signature of all of them."""
    rows = [r for r in items(30) if r[1]]
    df, method = spark.createDataFrame(rows, SCHEMA), MinHash()
    whole = {r["id"]: r["sig"] for r in method.signatures(df).collect()}
    tokens = df.select("id", F.explode("tokens").alias("token")).union(spark.createDataFrame([(0, None)], "id int, token string")).repartition(5)
    assert {r["id"]: r["sig"] for r in method.signatures_of_rows(tokens).collect()} == whole
    for i in range(3):
        tokens.where(F.pmod(F.xxhash64("id", "token"), F.lit(3)) == i).write.mode("append").parquet(f"file://{tmp_path}/rows")
    stream = spark.readStream.schema(tokens.schema).option("maxFilesPerTrigger", 2).parquet(f"file://{tmp_path}/rows")
    ingest.merged_index_stream(stream, f"file://{tmp_path}/parts", f"file://{tmp_path}/progress").awaitTermination()
    assert {r["id"]: r["sig"] for r in method.merged(spark.read.parquet(f"file://{tmp_path}/parts")).collect()} == whole
    with pytest.raises(ValueError):
        MinHash(compat=True).signatures_of_rows(tokens)


@pytest.mark.parametrize("cuts", [(3, 4, 9), (1, 2, 3)])
def test_answers_of_a_stream(spark, tmp_path, cuts):
    kinds = "PAAPAPPAAAP"
    rows = [("f", i + 1, f"{k}{i}", k == "A") for i, k in enumerate(kinds)] + [("g", 1, "x", True)]
    df = spark.createDataFrame(rows, "source string, at long, id string, is_answer boolean")
    for lo, hi in zip((0, *cuts), (*cuts, 99), strict=True):
        df.where((F.col("at") > lo) & (F.col("at") <= hi)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/rows")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/rows")
    for name, lo, hi in (("all", 1, 0), ("some", 2, 3)):
        ingest.write_stream(ingest.answers_stream(stream, lo, hi), f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}-progress").awaitTermination()
        found = sorted((r["at"], r["post_ordinal"], r["answers"]) for r in spark.read.parquet(f"file://{tmp_path}/{name}").collect())
        whole = posts.attach_positional(df.where("source = 'f'"), F.col("is_answer"), "at", lo=lo, hi=hi).collect()
        assert found == sorted((r["at"], r["post_ordinal"], r["answers"] and [a["id"] for a in r["answers"]]) for r in whole)


def test_observed_and_projector(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") * 0.5).alias("v"))
    assert sinks.write_observed(df, f"file://{tmp_path}/w", n=F.count(F.lit(1)), top=F.max("v")) == {"n": 100, "top": 49.5}
    assert spark.read.parquet(f"file://{tmp_path}/w").count() == 100
    rows = df.repartition(3).select(F.array("id", "v").alias("vec"), "id", F.concat(F.lit("t"), F.col("id") % 7).alias("t"))
    sinks.write_projector(rows, f"file://{tmp_path}/p", F.col("vec"), F.col("t").alias("Title"), F.col("id").alias("ID"))
    back = sinks.read_projector(spark, f"file://{tmp_path}/p", "Title string, ID long")
    assert {(r["ID"], r["Title"], tuple(r["vec"])) for r in back.collect()} == {(i, f"t{i % 7}", (str(float(i)), str(i * 0.5))) for i in range(100)}


def test_query_codes_and_cache(spark, tmp_path):
    asked = spark.createDataFrame([(1, "How to store a Connection-String?"), (2, None), (3, "the")], "id int, text string")
    codes = {r["id"]: r["code"] for r in ev.query_codes(asked, lambda x: x[:, :40]).collect()}
    assert any(codes[1]) and not any(codes[2]) and not any(codes[3])
    path = f"file://{tmp_path}/net"
    enc.Autoencoder("fcn", 2, rows=2).save(spark, path)
    first = enc.cached(spark, path)
    assert enc.cached(spark, path) is first
    enc.Autoencoder("fcn", 2, rows=2, seed=3).save(spark, path)
    assert enc.cached(spark, path) is not first and enc.cached(spark, path).settings["seed"] == 3


def test_batched_functions(spark):
    df = spark.createDataFrame([(1, ["abc", "x", None, "abc"]), (2, None), (3, [])], SCHEMA)
    rows = {r["id"]: r["h"] for r in df.select("id", hashing.xxh32_le32.over_arrays(F.filter("tokens", lambda t: t.isNotNull())).alias("h")).collect()}
    one = spark.createDataFrame([("abc",), (None,), ("x",)], "w string").select(hashing.xxh32_le32(F.col("w")).alias("h")).collect()
    assert rows[1] == [one[0]["h"], one[2]["h"], one[0]["h"]] and rows[2] is None and rows[3] == [] and one[0]["h"] == 0xFF53D132 and one[1]["h"] is None
    bits = spark.createDataFrame([([1.0, -2.0],), (None,), ([],)], "v array<float>").select(ft.float_bits(F.col("v")).alias("b")).collect()
    assert [b["b"] for b in bits] == ["0" * 2 + "1" * 7 + "0" * 23 + "11" + "0" * 30, None, ""]
    cells = spark.range(30).select(ft.drop_drawn_rows(F.array_repeat(F.lit(1.0), 16), 1, 5, F.col("id")).alias("x"))
    kept = [sum(r["x"]) for r in cells.collect()]
    assert all(11 <= k <= 15 for k in kept) and len(set(kept)) > 1


def test_a_frequent_word_alone_makes_no_pairs(spark):
    """Sets of ten words that have a single one in common are not candidates."""
    rows = spark.range(60).select(F.col("id").alias("class"), F.concat(F.array(F.lit("a")), F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.concat_ws("-", "id", i))).alias("tokens"))
    keyed = jaccard._keyed(rows, 0.5)
    assert jaccard.tiled_pairs(keyed, ["key"], "class", jaccard._may_reach(0.5), ("size", "at")).count() == 0
