"""Toxicity by a counterfactual-regularised linear classifier.

Features are the distinct words of a text (A-Z in lower case, ASCII punctuation as white space) and the
prefixes of 4 to 6 letters of each. Besides log-loss and an L1 penalty, training penalises how much the
score of a labelled text changes when its identity terms are swapped for others of the same kind:

    sum log-loss + L1 * |w| + SWAP * sum (f(x) - f(x with terms swapped))^2

so a neutral mention of a group can't carry weight that other groups don't. The model is linear in the
words of a text, so scoring is a sum over its distinct words, in the map tasks, with no shuffle.

The fit takes a bounded sample: TOXIC and CLEAN labelled rows at most, the lowest by a hash of their id
(one narrow top-k each), and of these no more than SAMPLED bytes of text of either label. Everything else
covers all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, numbered, table, trim, trimmed

#: Labelled rows of either label that the fit takes at most.
TOXIC, CLEAN = 4000, 6000
#: Bytes of the texts of either label that the fit takes at most; the first text is taken whatever its size.
SAMPLED = 64 << 20
#: A feature counts if so many sampled texts have it; so many features are fitted at most.
LEAST, FEATURES = 4, 20_000
L1, SWAP, ROUNDS = 2e-4, 1.0, 150
#: Scores from here on are predicted toxic.
CUT = 0.3
PREFIXES = (4, 5, 6)
#: Words whose weight a worker remembers.
REMEMBERED = 200_000

# Identity terms, by kind; a swap puts another term of the kind in a term's place.
IDENTITIES = (
    "woman man girl boy women men girls boys female male mujer hombre femme homme frau mann".split(),
    "muslim christian jewish buddhist hindu sikh catholic protestant atheist muslims christians jews".split(),
    "black white asian african latino hispanic arab european american indigenous roma".split(),
    "gay straight lesbian bisexual transgender queer heterosexual homosexual trans".split(),
    "german french spanish english chinese indian mexican turkish russian polish nigerian".split(),
    "old young elderly teenage disabled blind deaf autistic immigrant refugee foreigner".split(),
)
TERMS = {term: (k, i) for k, kind in enumerate(IDENTITIES) for i, term in enumerate(kind)}

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[str]:
    """Distinct words of a text in order of appearance."""
    return [w.decode(errors="ignore") for w in dict.fromkeys((text or "").encode().translate(_LOWER).split())]


def features(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in PREFIXES if len(word) >= n]]


def swapped(found: list[str], turn: int) -> list[str] | None:
    """The words with each identity term replaced by one that is `turn` places on in its kind; None without terms."""
    out = [IDENTITIES[TERMS[w][0]][(TERMS[w][1] + turn) % len(IDENTITIES[TERMS[w][0]])] if w in TERMS else w for w in found]
    return list(dict.fromkeys(out)) if out != found else None


class Rows:
    """A sparse matrix of counts in compressed rows."""

    def __init__(self, rows: list[list[int]], n: int) -> None:
        self.ends = np.cumsum([len(r) for r in rows]) if rows else np.empty(0, int)
        self.column = np.fromiter((i for r in rows for i in r), np.int64, int(self.ends[-1]) if rows else 0)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows]) if rows else np.empty(0, int)
        self.shape = len(rows), n

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, r[self.row], self.shape[1])


def fit(texts: list[list[str]], toxic: np.ndarray, prior: float | None = None, l1: float = L1, swap: float = SWAP, rounds: int = ROUNDS) -> tuple[dict[str, float], float]:
    """Weights of features and the intercept, by accelerated proximal gradient.

    texts: distinct words of each labelled text. prior: share of toxic rows among all labelled ones, where the sample
    has another; rows are weighted to it.
    """
    n, toxic = len(texts), np.asarray(toxic, float)
    share = toxic.mean() if n else 0.0
    if n == 0 or share in (0.0, 1.0):
        p = min(max(share if prior is None else prior, 1e-3), 1 - 1e-3)
        return {}, math.log(p / (1 - p))
    prior = share if prior is None else min(max(prior, 1e-3), 1 - 1e-3)
    weight = np.where(toxic == 1, prior / share, (1 - prior) / (1 - share)) / n
    by_class: list[dict[str, int]] = [{}, {}]
    for found, y in zip(texts, toxic, strict=True):
        count = by_class[int(y)]
        for f in {f for w in found for f in features(w)}:
            count[f] = count.get(f, 0) + 1
    sizes = n - toxic.sum(), toxic.sum()
    scores = {}
    for f in by_class[0].keys() | by_class[1].keys():
        a, b = by_class[1].get(f, 0), by_class[0].get(f, 0)
        if a + b >= LEAST or f in TERMS:
            p = (a + b) / n
            scores[f] = abs(a / sizes[1] - b / sizes[0]) / math.sqrt(max(p * (1 - p), 1e-9))
    del by_class
    kept = sorted(scores, key=lambda f: (f not in TERMS, -scores[f], f))[:FEATURES]
    number = {f: i for i, f in enumerate(kept)}
    coded = lambda found: [number[f] for w in found for f in features(w) if f in number]
    x = Rows([coded(t) for t in texts], len(kept))
    pairs = [(i, s) for i, t in enumerate(texts) if (s := swapped(t, 1 + i % 7)) is not None]
    original, other = Rows([coded(texts[i]) for i, _ in pairs], len(kept)), Rows([coded(s) for _, s in pairs], len(kept))
    swap_weight = swap * weight[[i for i, _ in pairs]] if pairs else np.empty(0)
    scale = np.sqrt(np.bincount(x.column, minlength=len(kept)) / n + 1e-4)  # frequent features take smaller steps
    w, bias = np.zeros(len(kept)), math.log(prior / (1 - prior))
    v, vb, t, rate = w.copy(), bias, 1.0, 1.0

    def loss(w: np.ndarray, bias: float) -> tuple[float, np.ndarray, np.ndarray]:
        z = x.dot(w / scale) + bias
        change = original.dot(w / scale) - other.dot(w / scale)
        return float(weight @ np.logaddexp(0, np.where(toxic == 1, -z, z)) + swap_weight @ change**2), z, change

    for _ in range(rounds):
        value, z, change = loss(v, vb)
        r = weight * (1 / (1 + np.exp(-z)) - toxic)
        g = (x.back(r) + original.back(2 * swap_weight * change) - other.back(2 * swap_weight * change)) / scale
        while True:
            new = v - rate * g
            new = np.sign(new) * np.maximum(np.abs(new) - rate * l1 / scale, 0)
            bias_new = vb - rate * r.sum()
            d, db = new - v, bias_new - vb
            if loss(new, bias_new)[0] <= value + g @ d + r.sum() * db + (d @ d + db * db) / (2 * rate) + 1e-12:
                break
            rate /= 2
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t_new * (new - w), bias_new + (t - 1) / t_new * (bias_new - bias)
        w, bias, t, rate = new, bias_new, t_new, rate * 1.1
    w = w / scale
    return {f: float(w[i]) for f, i in number.items() if w[i]}, float(bias)


def _sample(docs: DataFrame, labels: DataFrame, trains: Column, id_col: str, text_col: str) -> tuple[list[list[str]], np.ndarray, float]:
    """Distinct words and labels of the sampled rows, and the share of toxic among all training labels."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(trains)
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    rows = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "row", "place")
    there = rows.select("place", F.col("row.id").alias("id"), F.coalesce(F.octet_length("row.text"), F.lit(0)).alias("size"))
    there = there.join(known, F.col("id") == F.col("doc_id")).select("place", "id", "toxic", "size")
    order = F.xxhash64("id"), F.col("id"), F.col("place")
    parts = [there.where(F.col("toxic") == y).orderBy(*order).limit(most) for y, most in ((1, TOXIC), (0, CLEAN))]
    chosen = parts[0].unionByName(parts[1])  # TOXIC + CLEAN rows at most, whatever ids repeat
    before = F.sum("size").over(Window.partitionBy("toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    chosen = chosen.withColumn("upto", before).where((F.col("upto") <= SAMPLED) | (F.col("upto") == F.col("size"))).select("place", "toxic")
    rows = rows.join(F.broadcast(chosen), "place").select(F.col("row.id").alias("id"), F.col("row.text").alias("text"), "toxic")
    found = rows.select("id", "text", "toxic").mapInArrow(_words, "id string, words array<string>, toxic int").toArrow()
    order = np.argsort(np.array(found["id"].to_pylist(), dtype=str), kind="stable")
    toxic, sizes = np.array(found["toxic"].to_pylist(), float), pc.list_value_length(found["words"]).to_numpy()
    coded = pc.list_flatten(found["words"]).combine_chunks().dictionary_encode()  # a word is one object in all texts
    names, places = coded.dictionary.to_pylist(), np.split(coded.indices.to_numpy(), np.cumsum(sizes)[:-1]) if len(sizes) else []
    texts = [[names[k] for k in p.tolist()] for p in places]
    del found, coded
    return [texts[i] for i in order], toxic[order] if len(order) else toxic, (counts["toxic"] or 0) / max(counts["n"], 1)


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [words(x) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(found, pa.list_(pa.string())), b.column(2).cast(pa.int32())], names=["id", "words", "toxic"])


def train(docs: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, float], float]:
    """Fit on the rows of docs whose label (labels.toxic by labels.doc_id) meets `trains`, a condition on doc_id.

    A document with several labels is toxic if one says so; null labels and labels without a document are ignored;
    without any label, or with one kind only, the model is the share of toxic ones alone.
    """
    texts, toxic, prior = _sample(docs, labels, trains, id_col, text_col)
    model = fit(texts, toxic, prior if len(texts) else None)
    del texts
    trim()
    return model


def _scores(weights, bias: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = weights.value, {}

        def weigh(word: bytes) -> float:
            v = memory[word] = sum(model.get(f, 0.0) for f in features(word.decode(errors="ignore")))
            return v

        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                total = bias
                for w in set((text or "").encode().translate(_LOWER).split()):
                    v = memory.get(w)
                    total += weigh(w) if v is None else v
                out.append(1 / (1 + math.exp(-max(-700.0, min(700.0, round(total, 9))))))
                if len(memory) > REMEMBERED:
                    memory.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["row", "score"])

    return run


def score_toxicity(docs: DataFrame, model: tuple[dict[str, float], float], text_col: str = "text", cut: float = CUT) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from cut on).

    A null text counts as empty and scores as the intercept says. Columns of docs with the added names are replaced;
    repeated rows stay repeated; an empty table gives an empty result. The model has FEATURES weights at most and is
    broadcast.
    """
    own = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    rows = docs.select(F.struct(*own).alias("row"), F.col(text_col).cast("string").alias("text"))
    weights = docs.sparkSession.sparkContext.broadcast(model[0])
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("score", T.DoubleType())])
    scored = rows.mapInArrow(trimmed(_scores(weights, model[1])), schema)
    return scored.select("row.*", "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def toxicity_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    scored = score_toxicity(docs.select("doc_id", F.col("text").alias("body")), model, "body")
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
