"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from simsift.llm import bpe, exact, hpy, licenses, mixing, pca, secrets, simhash, tokens, toxicity
from simsift.llm.common import crc_mod
from simsift.llm.components import Forest, components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(40_000))


def rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "and", "é", "Straße"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts += [None, "", " ", "\t\n", "a  b", "a b", "a\tb", "A b", LONG, LONG + " x", "token: abcdefghijklmnop", "x" * 5000]
    out = [(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(texts)]
    out += [(100 + i, texts[i], None, None, None) for i in range(5)]  # copies
    return out + [out[3], out[3], (None, "a b", "en", "s0", 2), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(text):
    return __import__("re").sub(r"[\x20\x09-\x0D]+", " ", text or "")


def clash(df, *names):
    return df.withColumns({n: F.lit(7) for n in names})


# -- 2 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("heavy", [0.5, 0.02])
def test_exact(docs, empty, heavy, monkeypatch):
    monkeypatch.setattr(exact, "HEAVY", heavy)  # small: equal groups end in the trie
    monkeypatch.setattr(exact, "WIDTHS", (2, 3, 4096) if heavy < 0.1 else exact.WIDTHS)
    found = exact.mark_exact(clash(docs, "kept", "row", "body", "Group")).collect()
    assert len(found) == len(rows())
    groups = {}
    for r in rows():
        groups.setdefault(norm(r[1]), []).append(r[0])
    for r in found:
        ids = groups[norm(r["text"])]
        known = [i for i in ids if i is not None]
        assert (r["keep_id"], r["group_size"]) == (min(known) if known else None, len(ids))
        assert r["text_sha256"] == hashlib.sha256(norm(r["text"]).encode()).hexdigest() and r["Group"] == 7
    assert sorted(norm(r["text"]) for r in found if r["kept"]) == sorted(groups)
    assert exact.mark_exact(empty).count() == 0
    assert exact.drop_exact(docs).columns == docs.columns


def test_radix_classes():
    texts = [b"", b"a", b"a", b"ab" * 100, b"ab" * 100 + b"c", b"ab" * 100, b"a" * 16, b"a" * 17]
    found = sorted(sorted(g) for g in exact.radix_classes(texts))
    assert found == [[0], [1, 2], [3, 5], [4], [6], [7]]


# -- 5 -------------------------------------------------------------------------------------------


def plain_fingerprint(text, words=4):
    import xxhash

    t = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(t[i : i + words]), 42) for i in range(max(1, len(t) - words + 1))] if t else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    found = simhash.near_components(docs).collect()
    assert len(found) == len(rows())
    by_fp, names = {}, {}
    for r in rows():
        by_fp.setdefault(plain_fingerprint(r[1]), []).append(r[0])
    fps = list(by_fp)
    forest = Forest(len(fps))
    for i, a in enumerate(fps):
        near = [j for j, b in enumerate(fps) if (a ^ b).bit_count() <= 4]
        forest.join(np.full(len(near), i), np.array(near))
    for i, f in enumerate(fps):
        names.setdefault(int(forest.root(np.array([i]))[0]), []).extend(x for x in by_fp[f] if x is not None)
    for r in found:
        fp = r["fp"] % 2**64
        assert fp in by_fp and r["id"] in by_fp[fp]
        assert r["component_id"] == min(names[int(forest.root(np.array([fps.index(fp)]))[0])])
    assert simhash.near_components(empty).count() == 0


@pytest.mark.parametrize(("bits", "n"), [(4, 3000), (9, 400)])
def test_pigeonhole_is_complete(spark, bits, n):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = base[rng.integers(0, 40, n)]
    for _ in range(bits + 3):
        fps = fps ^ np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    fps = np.unique(fps)
    nodes = spark.createDataFrame([(int(x), int(x)) for x in fps.view(np.int64)], "fp long, node long")
    forest = Forest(len(fps))
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= bits)
        forest.join(np.full(len(near), i), near)
    expected = Counter(forest.root(np.arange(len(fps))).tolist())
    found = Counter(r["label"] for r in components(simhash.near_links(nodes, bits)).collect())
    assert sorted(found.values()) == sorted(v for v in expected.values() if v > 1)


def test_hot_keys_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 20)
    monkeypatch.setattr(simhash, "COUNTED", 1)
    test_pigeonhole_is_complete(spark, 4, 1500)


def test_large_bucket(monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 16)
    rng = np.random.default_rng(0)
    fps = np.unique(rng.integers(0, 2**20, 500, dtype=np.uint64) << np.uint64(40))
    nodes = simhash._Nodes(fps, 4)
    nodes.compare(np.arange(len(fps)), np.arange(64))
    plain = Forest(len(fps))
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4)
        plain.join(np.full(len(near), i), near)
    every = np.arange(len(fps))
    assert (nodes.forest.root(every) == plain.root(every)).all()


# -- 6 -------------------------------------------------------------------------------------------


def test_mix(docs, empty):
    found = mixing.mix(clash(docs, "size", "sub", "order", "copies")).collect()
    assert len(found) == len(rows())
    size = lambda t: len((t or "").encode().split())
    totals = Counter()
    for r in rows():
        totals[r[3]] += size(r[1])
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weights, targets = dict(zip(order, (5, 2, 1, 5), strict=True)), {}
    left, open_ = 1.5 * sum(totals.values()), set(order)
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * totals[s]}
        if not full:
            targets |= share
            break
        targets |= {s: 2.0 * totals[s] for s in full}
        left, open_ = left - sum(2 * totals[s] for s in full), open_ - full
    taken = Counter()
    for r in found:
        assert r["size"] == size(r["text"]) and r["source_size"] == totals[r["source"]] and 0 <= r["copies"] <= 2
        assert r["target"] == pytest.approx(targets[r["source"]])
        taken[r["source"]] += r["size"] * r["copies"]
    largest = max(size(r[1]) for r in rows())
    assert all(abs(taken[s] - targets[s]) <= largest / 2 + 1 for s in totals)
    copies = lambda rows_: Counter((r["doc_id"], r["text"], r["source"], r["copies"]) for r in rows_)
    assert copies(mixing.mix(docs.repartition(3)).collect()) == copies(found)
    assert mixing.mix(empty).count() == 0


def test_tilt(spark):
    """Every source comes to its target, at the one multiplier that bisection finds too."""
    shares = [0.0, 0.05, 0.5, 1.0, 1.3, 1.999, 2.0]
    size, n = np.array([5000.0, 300.0, 20.0, 1.0]), np.array([2, 40, 500, 9])
    total = float((size * n).sum())
    rows = [(None if k == 1 else f"s{k}", int(s), int(m), share * total) for k, share in enumerate(shares) for s, m in zip(size, n, strict=True)]
    rows += [("zero", 0, 5, 0.0)]
    found = mixing.tilt(spark.createDataFrame(rows, "source string, size long, n long, target double")).collect()
    assert len(found) == len(rows) and all(r["rate"] == 0 for r in found if r["source"] == "zero")
    c = size / ((size * size * n).sum() / total)
    for k, share in enumerate(shares):
        by_size = {r["size"]: r["rate"] for r in found if r["source"] == (None if k == 1 else f"s{k}")}
        rate = np.array([by_size[int(s)] for s in size])
        assert (size * n * rate).sum() == pytest.approx(share * total) and rate.max() <= 2
        low, high = -1e4, 1e4
        for _ in range(200):
            lam = (low + high) / 2
            low, high = (low, lam) if (size * n * np.minimum(2, np.exp(np.minimum(lam * c, 1)))).sum() > share * total else (lam, high)
        if 0 < share < 2:
            assert rate == pytest.approx(np.minimum(2, np.exp(np.minimum(low * c, 1))), rel=1e-6)
        copies = np.array(mixing.diffuse(size.tolist(), n.tolist(), rate.tolist()))
        assert abs((copies * size).sum() - share * total) <= 1 and (copies <= 2 * n).all()


# -- 8, 9 ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def library(tokenizer, text):
    tk = __import__("tokenizers").Tokenizer.from_file(tokenizer)
    return tk.encode(text or "", add_special_tokens=False).ids


ODD = "abcXYZéÉßÿŸñ'sStT0123.,;!?-_<|>()[]{}~`ªº×÷µ€œ中文́ \u0085 \x1c\tİK½²Ⅳ<|endoftext|>"


def test_encoder_matches_library(tokenizer):
    enc, rng = bpe.Encoder(tokenizer), random.Random(1)
    tk = __import__("tokenizers").Tokenizer.from_file(tokenizer)
    for n in [*range(1, 300), 5000, 20_000]:
        text = "".join(rng.choice(ODD) for _ in range(n))
        ids = tk.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == ids
        assert enc.decode(np.array(ids, "<u4").tobytes()) == tk.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "the", "中文字", "0123", "!?-", "é"])
@pytest.mark.parametrize("n", [2049, 9000, 40_000])
def test_unsplit_runs(tokenizer, alphabet, n):
    enc, rng = bpe.Encoder(tokenizer), random.Random(n)
    text = "".join(rng.choice(alphabet) for _ in range(n))
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == library(tokenizer, text)


def test_parts_join_in_any_tree(tokenizer):
    enc, rng = bpe.Encoder(tokenizer), random.Random(2)
    text = " ".join("".join(rng.choice("abcdé.'") for _ in range(rng.randint(0, 40))) for _ in range(200))
    whole = enc.encode([text])[0]
    for size in (1, 3, 17, 100):
        parts = [bpe.encode_part(text[i : i + size], enc) for i in range(0, len(text), size)]
        assert bpe.tree(parts, enc) == whole


def test_encode_texts(docs, empty, tokenizer):
    found = bpe.encode_texts(clash(docs, "ids", "key", "part"), tokenizer, long=1000, piece=300).collect()
    assert len(found) == len(rows())
    tk = __import__("tokenizers").Tokenizer.from_file(tokenizer)
    for r in found:
        ids = library(tokenizer, r["text"])
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids) and r["decoded"] == tk.decode(ids, skip_special_tokens=False)
    assert bpe.encode_texts(empty, tokenizer).count() == 0


def test_long_runs_are_encoded_by_pieces(spark, tokenizer, monkeypatch):
    """Runs without white space, cut into leaves that several tasks encode, are what the library makes of the whole."""
    monkeypatch.setattr(bpe, "RUN", 2000)
    rng = random.Random(8)
    texts = ["".join(rng.choice(a) for _ in range(n)) for a, n in (("abcdefgh", 30_000), ("the", 9000), ("ab0123.,!?é中<|>'s", 12_000), ("0123456789", 5000))]
    texts += [f"lead {texts[0]} middle words {texts[2]}<|endoftext|>{texts[1]} tail", "x" * 20_000, f" {texts[3]} ", " ".join(texts)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = bpe.encode_texts(df, tokenizer, long=1500, piece=700).collect()
    assert len(found) == len(texts)
    tk = __import__("tokenizers").Tokenizer.from_file(tokenizer)
    for r in found:
        ids = library(tokenizer, r["text"])
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded"] == tk.decode(ids, skip_special_tokens=False), r["doc_id"]


def test_direct_codes():
    rng = np.random.default_rng(3)
    for ids in (np.empty(0, np.uint32), np.array([0, 255, 256, 65535, 65536, 2**32 - 1]), rng.integers(0, 50_000, 5000), rng.integers(0, 200, 700)):
        codes = tokens.DirectCodes.load(tokens.DirectCodes.of(ids).dump())
        assert codes.slice(0, len(ids)).tolist() == ids.tolist()
        for i in range(0, len(ids), 37):
            assert codes[i] == ids[i] and codes.slice(i, min(len(ids), i + 700)).tolist() == ids[i : i + 700].tolist()
        with pytest.raises(IndexError):
            codes[len(ids)]


def test_token_files(spark, docs, empty, tokenizer, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/tokens"
    tokens.write_tokens(docs, path, tokenizer, shard=500)
    found = tokens.read_documents(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == sorted((r[0] for r in rows() if r[0] is not None)) + [None, None]
    at, stream = 0, []
    texts = {}
    for r in rows():
        texts.setdefault(r[0], []).append(r[1])
    for r in found:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == at and r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(r["ids"])
        assert ids in [[*library(tokenizer, t), 1] for t in texts[r["doc_id"]]]
        at, stream = at + len(ids), stream + ids
    asked = [0, 1, 499, 500, 501, len(stream) - 1, len(stream)]
    assert {r["position"]: r["token"] for r in tokens.read_tokens(spark, path, asked).collect()} == {i: stream[i] for i in asked[:-1]}
    table = spark.createDataFrame([(i,) for i in [*range(len(stream)), 3, -1, None]], "position long")
    for most in (tokens.PARTS, 1):  # shards in place, and sent on
        monkeypatch.setattr(tokens, "PARTS", most)
        assert sorted(tuple(r) for r in tokens.read_tokens(spark, path, table).collect()) == list(enumerate(stream))
    assert tokens.read_tokens(spark, path, []).count() == 0
    tokens.write_tokens(empty, f"file://{tmp_path}/none", tokenizer)
    assert tokens.read_documents(spark, f"file://{tmp_path}/none").count() == 0


# -- 3 -------------------------------------------------------------------------------------------


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(pca, "GROUP", 40)
    monkeypatch.setattr(pca, "TILE", 16)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    data = [(centres[i % 12] + rng.normal(size=24) * 0.35 * (i % 5)).tolist() for i in range(200)]
    data += [data[0], data[0], [x * 8 for x in data[1]], None, [], [0.0] * 24, [float("nan")] * 24, [None] + [1.0] * 23, [float("inf")] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0]]
    ids = [*range(len(data) - 1), None]
    df = spark.createDataFrame([(i, v, 7, 7) for i, v in zip(ids, data, strict=True)], "vec_id long, embedding array<double>, kept int, node int").repartition(4)
    found = pca.link_vectors(df).collect()
    assert len(found) == len(data)
    fit = [i for i, v in enumerate(data) if v and None not in v and np.isfinite(v).all() and any(v)]
    forest, links = Forest(len(data)), Counter()
    for i in fit:
        for j in fit:
            if i != j and len(data[i]) == len(data[j]) and np.dot(data[i], data[j]) / math.sqrt(np.dot(data[i], data[i]) * np.dot(data[j], data[j])) >= 0.9:
                links[i] += 1
                forest.join(np.array([i]), np.array([j]))
    root = forest.root(np.arange(len(data)))
    for r in found:
        i = ids.index(r["vec_id"])
        assert r["n_links"] == links[i] and r["component_id"] == ids[root[i]] and r["kept"] == (ids[root[i]] == r["vec_id"])
    assert sum(links.values()) > 100
    assert pca.link_vectors(df.limit(0)).count() == 0


# -- 4 -------------------------------------------------------------------------------------------


def test_toxicity(spark, docs, empty):
    rng = random.Random(3)
    plain = [f"p{i}" for i in range(80)]
    texts, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(20)]
        bad = rng.random() < 0.3
        if bad:
            words[rng.randrange(20)] = rng.choice(["awful", "vilexa", "vilexo", "vilexi"])
        if rng.random() < (0.6 if bad else 0.3):
            words[0] = "muslim"
        texts.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    df, known = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([*labels, (9999, 1, 1), (None, None, None), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, known, crc_mod("doc_id", 4) != 2)
    scored = {r["doc_id"]: r for r in toxicity.score_toxicity(clash(df, "score", "row"), model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([scored[i]["predicted"] == labels[i][2] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in scored.values())
    free = toxicity.fit([toxicity.words(t) for _, t in texts], np.array([b for *_, b in labels]), swap=0.0)[0]
    bound = toxicity.fit([toxicity.words(t) for _, t in texts], np.array([b for *_, b in labels]), swap=50.0)[0]
    weight = lambda w: abs(sum(w.get(f, 0.0) for f in toxicity.features("muslim")))
    assert weight(bound) < 0.5 * weight(free)
    assert toxicity.score_toxicity(docs, model).count() == len(rows()) and toxicity.score_toxicity(empty, model).count() == 0
    none = toxicity.train(df, known.where("toxic = 0"), F.lit(True))
    assert none[0] == {} and toxicity.train(empty, known.limit(0), F.lit(True))[0] == {}


@pytest.mark.parametrize("swap", [0.0, 3.0])
def test_toxicity_fit_reaches_the_least_loss(swap):
    """The fit's objective against a plain proximal gradient on dense matrices that runs until nothing changes."""
    rng = random.Random(4)
    texts = [[*rng.sample([f"p{i}" for i in range(25)], 6), *(["bad"] if rng.random() < 0.4 else []), *(["muslim"] if rng.random() < 0.4 else [])] for _ in range(120)]
    toxic = np.array([float(("bad" in t) != (rng.random() < 0.1)) for t in texts])
    weights, bias = toxicity.fit(texts, toxic, swap=swap, rounds=600)
    names = sorted({f for t in texts for w in t for f in toxicity.features(w)} | {f for i, t in enumerate(texts) for w in (toxicity.swapped(t, 1 + i % 7) or []) for f in toxicity.features(w)})
    names = [f for f in names if sum(f in {g for w in t for g in toxicity.features(w)} for t in texts) >= toxicity.LEAST or f in toxicity.TERMS]
    coded = lambda t: np.array([sum(f == g for w in t for g in toxicity.features(w)) for f in names], float)
    x = np.array([coded(t) for t in texts])
    other = np.array([coded(toxicity.swapped(t, 1 + i % 7) or t) for i, t in enumerate(texts)])
    n = len(texts)

    def loss(w, b):
        z = x @ w + b
        return np.logaddexp(0, np.where(toxic == 1, -z, z)).mean() + swap * (((x - other) @ w) ** 2).sum() / n + toxicity.L1 * np.abs(w).sum()

    w, b = np.zeros(len(names)), 0.0
    step = 1 / (np.linalg.norm(x, 2) ** 2 / (4 * n) + 2 * swap * np.linalg.norm(x - other, 2) ** 2 / n + 1)
    for _ in range(20_000):
        r = (1 / (1 + np.exp(-(x @ w + b))) - toxic) / n
        g = x.T @ r + 2 * swap / n * (x - other).T @ ((x - other) @ w)
        w = w - step * g
        w, b = np.sign(w) * np.maximum(np.abs(w) - step * toxicity.L1, 0), b - step * r.sum()
    mine = loss(np.array([weights.get(f, 0.0) for f in names]), bias)
    assert set(weights) <= set(names) and mine <= loss(w, b) + 2e-3


def test_toxicity_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLED", 100)
    df = spark.createDataFrame([(i, "w" * 40) for i in range(20)] + [(20, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(21)], "doc_id long, quality int, toxic int")
    texts, toxic, _ = toxicity._sample(df, labels, F.lit(True), "doc_id", "text")
    assert 2 <= toxic.sum() <= 3 and 2 <= len(texts) - toxic.sum() <= 3
    monkeypatch.setattr(toxicity, "SAMPLED", 1)
    texts, toxic, _ = toxicity._sample(df, labels, F.lit(True), "doc_id", "text")
    assert 1 <= toxic.sum() <= 2 and 1 <= len(texts) - toxic.sum() <= 2


# -- 7 -------------------------------------------------------------------------------------------


def test_licenses(spark, docs, empty):
    mit = licenses.TEMPLATES[3].text.split()
    texts = [
        "Released under the MIT License.", "mit license mit-license MIT\nlicense", "general public general public license", "xmit license", None,
        "the apache-license é MIT  licence", " ".join(mit[:20] + ["extra", "words"] + mit[20:]), " ".join(mit[:6]), "license " * 10, "x " * 3000 + "Apache License",
    ]
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    found = {r["id"]: r for r in licenses.find_licenses(clash(df, "key", "hits", "spans", "label")).collect()}
    starts = {i: [(s["start"], s["label"]) for s in r["spans"] if s["phrase"]] for i, r in found.items()}
    assert starts[0] == [(3, "mit")] and starts[1] == [(0, "mit"), (2, "mit"), (4, "mit")] and starts[2] == [(2, "gpl")]
    assert starts[3] == starts[4] == starts[8] == [] and starts[5] == [(1, "apache")] and starts[9] == [(3000, "apache")]
    assert found[6]["labels"] == ["mit"] and found[6]["score"] > 0.8 and found[7]["labels"] == [] and 0 < found[7]["score"] < 0.5
    assert found[4]["n_words"] == 0 and found[9]["n_words"] == 3002
    assert licenses.find_licenses(df).count() == len(texts) + 1

    def brute(text, t):  # complete phrases; of other templates the best window of words
        w, own = licenses.words(text), t.words
        if t.phrase:
            return any(w[i : i + len(own)] == own for i in range(len(w)))
        return any(licenses.common_words(own, w[i : i + len(own)]) >= 0.75 * len(own) for i in range(len(w)))

    rng, made = random.Random(9), []
    for k in range(60):
        t = rng.choice(licenses.TEMPLATES)
        w = t.text.split()
        if k % 3 == 1 and not t.phrase:  # a few edits
            for _ in range(len(w) // 20):
                w[rng.randrange(len(w))] = "zz"
        if k % 3 == 2:  # its grams in any order, with a word between
            w = [x for i in range(0, len(w) - 3) for x in (*w[i : i + 4], f"q{rng.randrange(99)}")]
            w = w if len(w) > 40 else ["nothing"]
        made.append((k, " ".join([*(f"x{rng.randrange(500)}" for _ in range(rng.randrange(80))), *w, *(f"y{rng.randrange(500)}" for _ in range(30))]), t.label))
    seen = {r["id"]: r for r in licenses.find_licenses(spark.createDataFrame([m[:2] for m in made], "doc_id long, text string")).collect()}
    for k, text, label in made:
        expected = {t.label for t in licenses.TEMPLATES if brute(text, t)}
        assert expected <= set(seen[k]["labels"]), (text, seen[k]["labels"])
        assert k % 3 == 2 or label in seen[k]["labels"]
        assert k % 3 != 2 or set(seen[k]["labels"]) <= expected, (text, seen[k])
    scrambled = " ".join(x for i in range(len(mit) - 3) for x in (*mit[i : i + 4], "filler"))
    row = licenses.find_licenses(spark.createDataFrame([(0, scrambled)], "doc_id long, text string")).first()
    assert row["labels"] == [] and row["score"] < 1
    assert licenses.find_licenses(docs).count() == len(rows()) and licenses.find_licenses(empty).count() == 0


# -- 10 ------------------------------------------------------------------------------------------


def test_secrets(spark, docs, empty, tmp_path):
    texts = [
        "token: password = abcdefghijklmnop", 'API_KEY="abcdefghijkl"', "apikey=short secret : abcdef0123456789abcdef", "AKIAABCDEFGHIJKLMN AKIASHORT akia" + "A" * 20,
        "é AKIA" + "Z" * 30 + "x" + "0" * 16, None, "", "0123456789abcde", "-----BEGIN RSA PRIVATE KEY-----",
    ]
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    spans = lambda r: [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
    ledger = f"file://{tmp_path}/ledger"
    found = {r["doc_id"]: spans(r) for r in secrets.find_secrets(clash(df, "spans", "seen", "rules", "_found", "found", "row"), ledger).collect()}
    assert found[0] == [] and found[1] == [("assign", 0, 21)]
    assert found[2] == [("assign", 13, 44), ("hex", 22, 44)]
    assert found[3] == [("access", 0, 18)] and found[4] == [("access", 2, 36), ("hex", 37, 53)]
    assert found[5] == found[6] == found[7] == [] and found[8] == [("private_key", 0, 31)]
    size = spark.read.parquet(ledger).count()
    assert size == len(set(t or "" for t in texts))
    assert secrets.find_secrets(df, ledger).count() == len(texts) + 1 and spark.read.parquet(ledger).count() == size
    many = spark.createDataFrame([(0, "é token = abcdefghijkl " * 1000)], "doc_id long, text string")
    assert spans(secrets.find_secrets(many).first()) == [("assign", 2 + 23 * i, 22 + 23 * i) for i in range(1000)]
    more = (*secrets.RULES, secrets.Rule("word", r"secret", 1))
    again = {r["doc_id"]: spans(r) for r in secrets.find_secrets(df, ledger, rules=more).collect()}
    assert again[2] == [("assign", 13, 44), ("word", 13, 19), ("hex", 22, 44)] or again[2][0] == ("assign", 13, 44)
    new = spark.read.parquet(ledger)
    assert new.count() == 2 * size and new.where("rules = array('word@1')").count() == size
    assert secrets.find_secrets(docs).count() == len(rows()) and secrets.find_secrets(empty).count() == 0


# -- 1 -------------------------------------------------------------------------------------------


def test_language_model(docs, empty):
    found = hpy.score_texts(clash(docs, "key", "held", "chunk"), crc_mod("doc_id", 5) == 1).collect()
    assert len(found) == len(rows())
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    words = lambda t: [*(t or "").encode().lower().split(), b" E"]
    counts = Counter(w for r in rows() if not held(r[0]) for w in words(r[1]))
    n, v = sum(counts.values()), len(counts)
    plain = Counter()
    for r in rows():
        t = words(r[1])
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        plain[r[0], held(r[0]), len(t), sum(w in counts for w in t), n, round(base, 6)] += 1
    assert plain == Counter((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found)
    assert all(r["score"] < 0 for r in found)
    again = hpy.score_texts(docs, crc_mod("doc_id", 5) == 1).collect()
    told = lambda rows_: sorted((str(r["id"]), r["n_tokens"], r["score"]) for r in rows_)
    assert told(again) == told(found)
    assert hpy.score_texts(empty, crc_mod("doc_id", 5) == 1).count() == 0
    assert all(abs(r["base_score"]) < 1e-9 for r in hpy.score_texts(docs, F.lit(True)).collect())


def plain_model(train, ask, discounts, seed, samples=60):
    """log10 probabilities of texts (lists of words) by the same model on one machine, averaged over many sweeps, each
    of which draws tables of dish by dish with all totals up to date."""
    rng = np.random.default_rng(seed)
    d, d0 = discounts
    count, vocabulary = Counter(), set()
    for t in train:
        count.update(zip(["^", *t], [*t, "$"], strict=True))
        vocabulary.update([*t, "$"])
    tables, root = dict.fromkeys(count, 1), dict.fromkeys(vocabulary, 1)
    customers, per = Counter(w for _, w in count), Counter(u for u, _ in count)
    of = Counter()
    for (u, _), c in count.items():
        of[u] += c
    uniform, dishes, roots = 1 / (len(vocabulary) + 1), hpy.Tables(d, 1.0), hpy.Tables(d0, 1.0)

    def parent(w):
        return (customers[w] - d0 * root.get(w, 0) + (1 + d0 * sum(root.values())) * uniform) / (1 + sum(customers.values()))

    total = [np.zeros(len(t) + 1) for t in ask]
    for k in range(samples + 10):
        for (u, w), c in count.items():
            t = int(dishes.draw(np.array([c]), np.array([parent(w)]), np.array([per[u] - tables[u, w]]), rng)[0])
            customers[w] += t - tables[u, w]
            per[u] += t - tables[u, w]
            tables[u, w] = t
        for w in root:
            root[w] = int(roots.draw(np.array([customers[w]]), np.array([uniform]), np.array([sum(root.values()) - root[w]]), rng)[0])
        if k >= 10:
            for n, t in enumerate(ask):
                pairs = zip(["^", *t], [*t, "$"], strict=True)
                total[n] += [(count[u, w] - d * tables.get((u, w), 0) + (1 + d * per[u]) * parent(w)) / (1 + of[u]) for u, w in pairs]
    return [float(np.log10(t / samples).sum()) for t in total]


def test_agrees_with_a_model_on_one_machine(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.8)) % 40}" for _ in range(60)]
    train = [[rng.choice(words) for _ in range(rng.randint(1, 30))] for _ in range(60)]
    ask = [[rng.choice(words) for _ in range(10)] for _ in range(8)] + [[], ["new", "words", "w1"]]
    rows_ = [(i, " ".join(t), i >= len(train)) for i, t in enumerate(train + ask)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, held boolean").repartition(3)
    seen = []
    make = hpy.Model.__init__
    monkeypatch.setattr(hpy.Model, "__init__", lambda self, *a: (make(self, *a), seen.append(self.discounts))[0])
    for bucket in (500_000, 60):  # in small buckets, many words are frequent
        monkeypatch.setattr(hpy, "BUCKET", bucket)
        score = {r["id"]: r["score"] for r in hpy.score_texts(df, F.col("held"), burn_in=6, samples=12).collect()}
        expected = plain_model(train, ask, seen[-1], 3)
        for i, e in enumerate(expected):
            assert score[len(train) + i] == pytest.approx(e, abs=0.05 * (len(ask[i]) + 1)), i


def test_probabilities_sum_to_one(spark):
    """The probabilities of all words of the vocabulary, of one unseen word and of the end add up to 1 after a context."""
    rng = random.Random(1)
    text = [(i, f"go {rng.choice('abcde')}") for i in range(200)]
    every = ["a", "b", "c", "d", "e", "go", "new"]
    ask = {"go": "go", "": ""} | {f"go {w}": f"go {w}" for w in every} | {f"go {w} {v}": f"go {w} {v}" for w in every for v in every} | {w: w for w in every}
    df = spark.createDataFrame([(i, t, False) for i, t in text] + [(1000 + k, t, True) for k, t in enumerate(ask)], "doc_id long, text string, held boolean")
    score = {r["id"]: r["score"] for r in hpy.score_texts(df, F.col("held")).collect()}
    p = {t: 10 ** score[1000 + k] for k, t in enumerate(ask)}
    # P(v | w) P(end | v) / P(end | w) is known for all w and v; that P(. | w) adds up to 1 gives P(end | w)
    ratios = np.array([[p[f"go {w} {v}"] / p[f"go {w}"] for v in every] for w in every])
    end = np.ones(len(every))
    for _ in range(200):
        end = 0.5 * end + 0.5 / (1 + (ratios / end[None, :]).sum(axis=1))
    start = {w: p[w] / e for w, e in zip(every, end, strict=True)}  # P(w | start)
    assert sum(start.values()) + p[""] == pytest.approx(1, abs=0.01)  # words, one unseen word, and the end
    first = {w: p[f"go {w}"] for w in "abcde"}
    assert all(first[w] > p["go new"] for w in first)


@pytest.mark.parametrize("partitions", [9])
def test_scores_do_not_hang_on_partitions(spark, docs, partitions):
    told = lambda: sorted(((str(r["id"]), r["n_tokens"], r["score"]) for r in hpy.score_texts(docs.repartition(partitions), crc_mod("doc_id", 5) == 1).collect()), key=str)
    before, kept = told(), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        after = sorted(((str(r["id"]), r["n_tokens"], r["score"]) for r in hpy.score_texts(docs.repartition(2), crc_mod("doc_id", 5) == 1).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert [(a, b) for a, b, _ in before] == [(a, b) for a, b, _ in after]
    assert [c for *_, c in before] == pytest.approx([c for *_, c in after], rel=1e-9)


def test_tables_are_drawn_exactly():
    rng = np.random.default_rng(0)

    def exact(c, d):  # by summing over all seatings of c customers, a new table weighing 0.3 * (2 + d * tables)
        p = {1: 1.0}
        for n in range(1, c):
            q = {}
            for t, x in p.items():
                q[t] = q.get(t, 0) + x * (n - d * t)
                q[t + 1] = q.get(t + 1, 0) + x * 0.3 * (2 + d * (5 + t))
            p = q
        return {t: x / sum(p.values()) for t, x in p.items()}

    draws, many = hpy.Tables(0.7, 2.0), lambda c, n: (np.full(n, c), np.full(n, 0.3), np.full(n, 5.0), rng)
    for c in (1, 2, 3, 7, 30):
        got = Counter(draws.draw(*many(c, 20_000)).astype(int).tolist())
        for t, p in exact(c, 0.7).items():
            assert abs(got[t] / 20_000 - p) < 0.015, (c, t)
    for c in (1025, 1500, 4000):  # beyond EXACT
        mean = draws.filtered(*many(c, 2000)).mean(), draws.exact(c, *many(c, 2000)[1:])[:, 0].mean()
        assert 0.9 < mean[0] / mean[1] < 1.12, (c, mean)
    assert draws.draw(np.array([0, 10**6]), np.array([1.0, 1.0]), np.zeros(2), rng)[0] == 0


# -- pieces --------------------------------------------------------------------------------------


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (200, 105), (105, 101)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == dict.fromkeys(range(31), 0) | dict.fromkeys((100, 101, 105, 200), 100)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_workers_give_memory_back(monkeypatch):
    import pyarrow as pa

    from simsift.llm import recompress

    calls, block = [], pa.table({"x": list(range(1000))})
    monkeypatch.setattr(recompress, "trim", lambda: calls.append(1))
    monkeypatch.setattr(recompress, "TRIMMED", 3 * block.nbytes)
    run = recompress._returned(lambda key, a, b: a)
    assert all(run((1,), block, block) is block for _ in range(6)) and len(calls) == 3
