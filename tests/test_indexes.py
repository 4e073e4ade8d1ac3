"""The three indexes on small fixed sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from simsift.operators import evaluate as ev
from simsift.operators.hamming import BlockIndex, brute_force
from simsift.operators.minhash import MinHash, MinHashIndex, best_bands
from simsift.operators.prefix import PrefixIndex

VECTORS = {1: "1110100100", 2: "1010100100", 3: "1010110101", 4: "1011100111"}
EXPECTED = [
    ("1110100100", 1, {1}), ("1110100101", 1, {1}), ("1110110101", 1, {1}), ("1110110101", 2, {1, 2}), ("1010110101", 1, {3}),
    ("1010100100", 1, {2}), ("1111111111", 4, {1, 2, 3, 4}),
]


def bits(s):
    return [int(c) for c in s]


@pytest.fixture(scope="module")
def prefix(spark):
    return PrefixIndex.build(spark.createDataFrame([(i, bits(v)) for i, v in VECTORS.items()], "id int, vec array<int>"), 10)


@pytest.mark.parametrize(("vector", "k", "ids"), EXPECTED)
def test_prefix(spark, prefix, vector, k, ids):
    asked = spark.createDataFrame([(0, bits(vector))], "id int, vec array<int>")
    assert {r["id"] for r in prefix.search(asked, k).collect()} == ids


def test_prefix_saved(spark, prefix, tmp_path):
    prefix.save(f"file://{tmp_path}/prefix")
    again = PrefixIndex.load(spark, f"file://{tmp_path}/prefix")
    asked = spark.createDataFrame([(n, bits(v)) for n, (v, k, _) in enumerate(EXPECTED) if k == 1], "id int, vec array<int>")
    found = {r["query"]: {r["id"]} for r in again.search(asked, 1).collect()}
    assert found == {n: ids for n, (_, k, ids) in enumerate(EXPECTED) if k == 1}
    assert again.size().first()[0] == 4


def test_prefix_matches_brute_force(spark):
    import random

    random.seed(4)
    rows = [(i, [random.randint(0, 1) for _ in range(8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, vec array<int>")
    found = {}
    for r in PrefixIndex.build(df, 8, 5).search(df, 5).orderBy("query", "place").collect():
        found.setdefault(r["query"], []).append(r["id"])
    lcp = lambda a, b: next((i for i in range(8) if a[i] != b[i]), 8)
    for q, v in rows:
        best = sorted(((-lcp(v, w), w, i) for i, w in rows if lcp(v, w)))[:5]
        assert found[q] == [i for _, _, i in best]


KEYS = ["1110", "1010", "1111", "1000", "1001", "1101", "0101"]


def test_blocks(spark):
    entries = spark.createDataFrame([(bits(k), f"v{i}") for i, k in enumerate(KEYS)], "key array<int>, val string")
    asked = spark.createDataFrame([("absent", bits("1011")), ("there", bits("1010"))], "query string, key array<int>")
    assert [r["query"] for r in brute_force(entries, asked).collect()] == ["there"]
    index = BlockIndex.build(entries, 2)
    found = index.search(asked.where("query = 'there'"), 3).collect()
    assert 0 < len(found) <= 3 and found[0]["distance"] == 0
    assert [r["key"] for r in index.content().collect()] == sorted(bits(k) for k in KEYS)
    assert index.search(spark.createDataFrame([("low", [0, 0, 0, 0])], "query string, key array<int>"), 9).count() == 2


def test_best_bands():
    assert best_bands(0.5, 128) == (25, 5)
    assert best_bands(0.8, 128) == (9, 13)
    assert best_bands(0.0005, 128) == (128, 1)


SENTENCES = {1: "i have a pen i have an apple", 2: "numpy python", 3: "please work", 4: "maple story good game"}


@pytest.mark.parametrize("compat", [False, True])
def test_minhash_finds_itself(spark, compat):
    items = spark.createDataFrame([(i, s.split()) for i, s in SENTENCES.items()], "id int, tokens array<string>")
    index = MinHashIndex.build(items, MinHash(threshold=0.3, compat=compat))
    asked = spark.createDataFrame([(1, SENTENCES[1].split()), (2, "numpy python matrix".split()), (4, SENTENCES[4].split())], items.schema)
    hits = {(r["query"], r["id"]) for r in index.search(asked).collect()}
    assert {(1, 1), (2, 2), (4, 4)} <= hits


def test_signature_ignores_order_and_repeats(spark):
    rows = [(1, "a b c".split()), (2, "c a b a".split()), (3, "d e".split()), (4, [])]
    signed = {r["id"]: r["sig"] for r in MinHash().signatures(spark.createDataFrame(rows, "id int, tokens array<string>")).collect()}
    assert signed[1] == signed[2] != signed[3] and 4 not in signed


def test_copies_and_insert(spark):
    rows = [(i, "same words every time".split()) for i in range(30)]
    index = MinHashIndex.build(spark.createDataFrame(rows, "id int, tokens array<string>"))
    assert index.classes.count() == 1 and index.candidates().count() == 0
    more = index.insert(spark.createDataFrame([(99, "same words every time".split()), (100, ["other"])], "id int, tokens array<string>"))
    assert more.size().first()[0] == 32 and more.classes.count() == 2
    found = more.search(spark.createDataFrame(rows[:1], "id int, tokens array<string>"), 10).orderBy("place").collect()
    assert [r["id"] for r in found] == list(range(10))


def test_evaluation(spark):
    items = spark.createDataFrame([(i, s.split()) for i, s in SENTENCES.items()], "id int, tokens array<string>")
    indexes = {"sha1": ev.make_index(items), "xxh32": ev.make_index(items, "xxh32"), "whole": ev.make_index(items, whole=True)}
    wide = ev.hits(ev.compare(items, indexes), list(indexes))
    titles = wide.where("kind = 'title'")
    assert titles.count() == 4 and titles.where("sha1 and xxh32 and whole").count() == 4
    assert wide.where("kind = 'dropped' and whole").count() == 0
    sums = {r["index_name"]: r["hits"] for r in ev.recall(wide, list(indexes)).collect()}
    assert sums["whole"] == 4 and sums["sha1"] >= 4
    found = ev.expected(spark.createDataFrame([(1, "13")], "query int, id string"), spark.createDataFrame([(1, 13), (2, 5)], "query int, wanted int"))
    assert {r["query"]: r["found"] for r in found.collect()} == {1: True, 2: False}
    assert items.select(F.size(ev.without_words(F.col("tokens"), 2)).alias("n")).agg(F.max("n")).first()[0] == 6


def test_blocks_insert(spark):
    rows = [(bits(k), i) for i, k in enumerate(KEYS)]
    make = lambda some: spark.createDataFrame(some, "key array<int>, val int")
    whole, grown = BlockIndex.build(make(rows), 3), BlockIndex.build(make(rows[:4]), 3).insert(make(rows[4:]))
    shown = lambda i: [(r["key"], r["val"], r["block"]) for r in i.content().collect()]
    assert shown(grown) == shown(whole) and len(grown.runs) == 2
    asked = spark.createDataFrame([(n, bits(k)) for n, k in enumerate(["0000", "1001", "1111", "1000"])], "query int, key array<int>")
    firsts = sorted((r["first"], r["block"]) for r in whole.runs[0][1].collect())
    for r in grown.block_of(asked).collect():
        assert r["block"] == max([b for f, b in firsts if f <= r["asked"]], default=firsts[0][1])


def test_prefix_insert(spark):
    rows = [(i, bits(f"{i * 37 % 64:06b}")) for i in range(60)]
    make = lambda some: spark.createDataFrame(some, "id int, vec array<int>")
    found = [sorted(map(tuple, i.search(make(rows), 3).collect())) for i in (PrefixIndex.build(make(rows), 6, 3), PrefixIndex.build(make(rows[:20]), 6, 3).insert(make(rows[20:])))]
    assert found[0] == found[1]


def test_blocks_by_single_inserts(spark, tmp_path, monkeypatch):
    """Entries inserted one after the other, in memory or on disk, merged or not, are found as in an index built at once."""
    import random

    from simsift.operators import hamming

    rng = random.Random(5)
    rows = [([rng.randint(0, 1) for _ in range(6)], i) for i in range(60)]  # many equal keys
    make = lambda some: spark.createDataFrame(some, "key array<int>, val int")
    asked = spark.createDataFrame([(i, [rng.randint(0, 1) for _ in range(6)]) for i in range(12)] + [(90, [0] * 6), (91, [1] * 6)], "query int, key array<int>")
    told = lambda i: sorted(map(tuple, i.search(asked, 4).collect()))
    spots = lambda i: sorted((r["query"], r["block"]) for r in i.block_of(asked).collect())
    path = f"file://{tmp_path}/blocks"
    grown = BlockIndex.build(make(rows[:50]), 7)
    grown.save(path)
    for at in (50, 51, 52):
        grown = grown.insert(make(rows[at : at + 1]))
        BlockIndex.append(make(rows[at : at + 1]), path)
    grown, saved = grown.insert(make(rows[53:])), BlockIndex.append(make(rows[53:]), path)
    whole = BlockIndex.build(make(rows), 7)
    assert len(grown.runs) == len(saved.runs) == 5
    for other in (grown, saved, saved.compact()):
        assert told(other) == told(whole) and spots(other) == spots(whole)
    monkeypatch.setattr(hamming, "RUNS", 2)
    merged = grown.insert(make([([0] * 6, 99)]))
    assert len(merged.runs) == 2 and told(merged) == told(BlockIndex.build(make([*rows, ([0] * 6, 99)]), 7))


def test_writes_follow_the_insert(spark, tmp_path):
    """An insert writes rows in proportion to what it inserts, whatever the index holds."""
    from simsift.sources import sinks

    make = lambda lo, hi: spark.range(lo, hi).select("id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.pmod(F.call_function("shiftright", F.xxhash64("id"), b.cast("int")), F.lit(2)).cast("int")).alias("vec"))
    entry = lambda df: df.select(F.col("vec").alias("key"), F.col("id").alias("val"))
    item = lambda df: df.select("id", F.array(F.concat(F.lit("w"), F.pmod("id", F.lit(500))), F.concat(F.lit("v"), F.pmod("id", F.lit(450)))).alias("tokens"))
    for kind, of in ((BlockIndex, entry), (PrefixIndex, lambda df: df), (MinHashIndex, item)):
        path = f"file://{tmp_path}/{kind.__name__}"
        index = kind.build(of(make(0, 800)), 16) if kind is PrefixIndex else kind.build(of(make(0, 800)))
        index.save(path)
        rows = lambda: sum(t.count() for t in sinks.load_index(spark, path)[0].values())  # noqa: E731, B023
        before = rows()
        kind.append(of(make(800, 810)), path)
        assert 10 <= rows() - before <= 10 * 60, kind
        assert sinks.versions(spark, path) == [1, 2]


def test_prefix_rows_stay_few(spark):
    """A vector is listed a few times, however many bits it has, and an insert leaves what is known alone."""
    import random

    rng = random.Random(3)
    rows = [(i, [rng.randint(0, 1) for _ in range(200)]) for i in range(300)] + [(1000 + i, [1] * 200) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, vec array<int>")
    index = PrefixIndex.build(df, 200, 5)
    assert index.lists.count() < 8 * len(rows)
    grown = PrefixIndex.build(df.where("id % 3 = 0"), 200, 5).insert(df.where("id % 3 = 1")).insert(df.where("id % 3 = 2"))
    asked = spark.createDataFrame([(1000 * i + cut, v[:cut] + [1 - b for b in v[cut:]]) for i, (_, v) in enumerate(rows[::17]) for cut in (3, 9, 100, 200)], df.schema)
    lcp = lambda a, b: next((i for i in range(200) if a[i] != b[i]), 200)
    expected = set()
    for q in asked.collect():
        best = sorted((-lcp(q["vec"], w), w, i) for i, w in rows if lcp(q["vec"], w))[:5]
        expected |= {(q["id"], i, -n) for n, _, i in best}
    for other in (index, grown, grown.compact()):
        found = other.search(asked, 5)
        assert {(r["query"], r["id"], r["length"]) for r in found.collect()} == expected


def test_minhash_grown_is_as_built(spark):
    rows = [(i, f"w{i % 7} w{i % 5} w{i % 3} same".split()) for i in range(40, 0, -1)]
    make = lambda some: spark.createDataFrame(some, "id int, tokens array<string>")
    whole, grown = MinHashIndex.build(make(rows)), MinHashIndex.build(make(rows[:25])).insert(make(rows[25:39])).insert(make(rows[39:]))
    told = lambda df: sorted(map(tuple, df.collect()))
    assert told(grown.candidates()) == told(whole.candidates()) and grown.size().first()[0] == 40
    assert told(grown.search(make(rows[:6]), 4)) == told(whole.search(make(rows[:6]), 4)) and grown.classes.count() == whole.classes.count()


def test_versions(spark, tmp_path, monkeypatch):
    """A writer that dies between tables leaves the version before; a reader keeps the one it opened; two writers clash."""
    from simsift.sources import sinks

    path, df = f"file://{tmp_path}/index", spark.range(3)
    assert sinks.versions(spark, path) == [] and sinks.save_index({"a": df, "b": df.where("id > 5")}, {"x": 1}, path) == 1
    opened, settings = sinks.load_index(spark, path)
    assert settings == {"x": 1} and opened["b"].count() == 0
    publish = sinks._published
    monkeypatch.setattr(sinks, "_published", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        sinks.append_index({"a": df}, path)
    monkeypatch.setattr(sinks, "_published", publish)
    assert sinks.versions(spark, path) == [1] and sinks.load_index(spark, path)[0]["a"].count() == 3
    assert sinks.append_index({"a": spark.range(10, 12)}, path) == 2
    assert sinks.load_index(spark, path)[0]["a"].count() == 5 and opened["a"].count() == 3 and sinks.load_index(spark, path, version=1)[0]["a"].count() == 3
    with pytest.raises(RuntimeError):
        publish(spark, path, {}, 2)
    assert sinks.save_index({"a": spark.range(1)}, {"x": 3}, path) == 3 and sinks.vacuum_index(spark, path) == 4
    assert sinks.versions(spark, path) == [3] and sinks.load_index(spark, path)[0]["a"].count() == 1


def test_whole_titles_with_one_hash_are_two_classes(spark):
    import hashlib

    seen, pair = {}, None
    for i in range(2_000_000):
        h = int.from_bytes(hashlib.sha1(f"t{i}".encode()).digest()[:4], "little") % ((1 << 31) - 1)
        if h in seen:
            pair = seen[h], i
            break
        seen[h] = i
    rows = spark.createDataFrame([(1, [f"t{pair[0]}"]), (2, [f"t{pair[1]}"]), (3, [f"t{pair[0]}"])], "id long, tokens array<string>")
    index = MinHashIndex.build(rows, MinHash(shingle="whole"))
    assert sorted(map(tuple, index.members.collect())) == [(1, 1), (2, 2), (3, 1)]
    assert sorted((r["query"], r["id"]) for r in index.search(rows).collect()) == [(1, 1), (1, 3), (2, 2), (3, 1), (3, 3)]


def test_queries_of_one_signature_are_searched_once(spark, monkeypatch):
    from simsift.operators import minhash

    seen, join = [], minhash.tiled_join

    def counted(asked, *rest):
        seen.append(asked.count())
        return join(asked, *rest)

    monkeypatch.setattr(minhash, "tiled_join", counted)
    rows = spark.createDataFrame([(i, ["a", "b", "c"]) for i in range(30)] + [(50, ["x", "y"])], "id long, tokens array<string>")
    method = MinHash()
    found = MinHashIndex.build(rows, method).search(rows, 4).collect()
    assert seen == [2 * method.bands[0]]
    assert sorted((r["query"], r["id"], r["place"]) for r in found) == sorted([(q, i, i + 1) for q in range(30) for i in range(4)] + [(50, 50, 1)])


def test_signatures_are_made_in_batches(spark):
    """Signatures by arrays of numbers, 300 items at a time and more, against each number; no hashes, no signature."""
    from simsift.operators import minhash

    rng = random.Random(4)
    rows = [(i, [rng.randrange(1 << 32) for _ in range(rng.randint(0, 20))]) for i in range(600)] + [(600, None), (601, [0, minhash.PRIME, 2**32 - 1])]
    df = spark.createDataFrame(rows, "id long, hashes array<long>").coalesce(1)
    found = df.select("id", minhash.native_signature(F.col("hashes"), 5).alias("sig"))
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    wanted = {i: [min((a * h + b) % minhash.PRIME for h in hs) for a, b in minhash.permutations(5)] if hs else None for i, hs in rows}
    assert {r["id"]: r["sig"] for r in found.collect()} == wanted


def test_codes_are_searched_once(spark, monkeypatch):
    """Queries of one code are one search; each has its results."""
    from simsift.operators import evaluate

    items = spark.createDataFrame([(i, ["abc"[i % 3]]) for i in range(30)], "id long, tokens array<string>")
    asked, kept = [], evaluate.nearest
    monkeypatch.setattr(evaluate, "nearest", lambda e, q, *a: (asked.append(q.count()), kept(e, q, *a))[1])
    index = evaluate.CodeIndex(items, lambda x: x[:, :3] - 0.5, 3, "hamming", 0.0)
    found = {(r["query"], r["place"]): r["id"] for r in index.search(items, 10).collect()}
    assert asked == [3] and len(found) == 300
    assert all([found[i, k] for k in range(1, 11)] == list(range(i % 3, 30, 3)) for i in range(30))
    prefix = evaluate.CodeIndex(items, lambda x: x[:, :3] - 0.5, 3, "prefix", 0.0).search(items, 10)
    assert prefix.groupBy("query").count().count() == 30


def test_bands_are_of_whole_texts(spark, tmp_path):
    """Texts that differ after many words have other bands; a text may be longer than what is permuted at once."""
    from simsift.operators import minhash
    from simsift.plans.catalogue import QUERIES

    words = [f"w{i}" for i in range(9000)]
    rows = [(1, " ".join(words[:20])), (2, " ".join(words[:16])), (3, " ".join(words)), (4, "the"), (5, None), (6, "w1 w0")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    keys = {}
    for r in QUERIES["minhash_bands"](spark, f"file://{tmp_path}").orderBy("id", "band").collect():
        keys.setdefault(r["id"], []).append(r["key"])
    assert sorted(keys) == [1, 2, 3, 6] and keys[1] != keys[2] != keys[3]
    from hashlib import sha1

    hashes = np.array([int.from_bytes(sha1(w.encode()).digest()[:4], "little") % minhash.PRIME for w in words])
    sig = [int(((a * hashes + b) % minhash.PRIME).min()) for a, b in minhash.permutations(125)]
    assert keys[3] == [",".join(map(str, sig[i : i + 5])) for i in range(0, 125, 5)]


def test_tiles_find_what_bands_find(spark, monkeypatch, tmp_path):
    """Classes in several tiles, pairs in parts, one key that all have; against look-ups of bands and plain counts."""
    from simsift.operators import minhash

    rng = random.Random(6)
    rows = [(i, rng.sample([f"w{k}" for k in range(14)], rng.randint(1, 9))) for i in range(1, 300)] + [(i, ["all", "same"]) for i in range(300, 330)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>").repartition(3)
    asked = spark.createDataFrame([((i, "x"), t + ["more"] * (i % 2)) for i, t in rows if i % 3], "id struct<a:int,b:string>, tokens array<string>")
    told = lambda found: sorted(map(tuple, found.collect()))
    method = MinHash(threshold=0.4)
    plain = MinHashIndex.build(df, method)
    joined = told(plain.search(asked, 4)), told(plain.candidates())
    for name, value in (("MANY", 0), ("HELD", 90), ("MET", 500), ("SCORED", 70)):
        monkeypatch.setattr(minhash, name, value)
    monkeypatch.setattr(minhash, "tiled_join", None)
    monkeypatch.setattr(minhash, "tiled_pairs", None)
    index = MinHashIndex.build(df, method)
    assert (told(index.search(asked, 4)), told(index.candidates())) == joined and len(joined[1]) > 100
    signed = {r["id"]: r["sig"] for r in method.signatures(df).collect()}
    bands, size = method.bands
    pairs, named = set(), {}
    for i in sorted(signed):
        named.setdefault(tuple(signed[i]), i)
    for s, a in named.items():
        for t, b in named.items():
            if a < b and any(s[k * size : (k + 1) * size] == t[k * size : (k + 1) * size] for k in range(bands)):
                pairs.add((a, b, sum(x == y for x, y in zip(s, t, strict=True)) / 128))
    assert set(joined[1]) == pairs
    index.save(f"file://{tmp_path}/index")
    assert told(MinHashIndex.load(spark, f"file://{tmp_path}/index").search(asked, 4)) == joined[0]


def test_search_keeps_no_signatures(spark, tmp_path, monkeypatch):
    """Disk of an index and a search: hashes of titles, not their signatures of a kilobyte."""
    from simsift import session

    rng = random.Random(7)
    rows = [(i, [f"w{rng.randrange(10**6)}" for _ in range(12)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    monkeypatch.setattr(session, "shared_dir", lambda s: f"file://{tmp_path}/own")
    assert MinHashIndex.build(df).search(df, 2).count() == 3000
    used = sum(p.stat().st_size for p in (tmp_path / "own").rglob("*.parquet"))
    assert used < 3000 * 1200, used / 3000


def test_results_are_listed_once_for_each_kind(spark, monkeypatch):
    """Copies of a query are one row until their results are listed; whole titles are found without bands."""
    from simsift.operators import minhash

    items = spark.createDataFrame([(i, ["a", "b", "c"]) for i in range(40)] + [(50, ["x", "y"])], "id long, tokens array<string>")
    monkeypatch.setattr(minhash, "tiled_join", None)
    index = ev.make_index(items, whole=True)
    kinds, found = index.searched(items, 10)
    assert (kinds.count(), kinds.select("kind").distinct().count(), found.count()) == (41, 2, 11)
    told = {(r["id"], r["kind"]): r["results"] for r in ev.compare(items, {"whole": index}).collect()}
    assert told[3, "title"] == list(range(10)) and told[50, "title"] == [50] and told[50, "dropped"] == [] and len(told) == 82
