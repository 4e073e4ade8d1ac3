"""Vectors of whole sentences that predict their words (distributed bag of words, negative sampling), over all sentences.

The vocabulary and the sentences are dealt to the same number of blocks. An epoch has as many turns as there are blocks:
in a turn block i of the sentences meets block i + turn of the words, so that no two tasks change the same vector, and
after all turns every sentence has met all its words. A task holds one block of words; sentences stream through it, each
with its vector and the places of its words in that block, and negatives are drawn from the block by frequency. Rows of
the state are packs of words or of sentences; the places of words are written once and read by the turn that needs them.
The state is written after each epoch, which survives lost executors.

A step takes as many sentences as change the most frequent word of a block `TOUCHED` times on average, all from the same
words' vectors; where a word is in most sentences, that is a few sentences at a time.

A sentence draws by its words alone, so the vector of any sentence, seen or not, is inferred against the words' vectors,
which then stay as they are, and equal sentences have equal ones. Tasks that can hold all words infer in one job.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import removed, scratch, stored, temporary

#: Numbers of a block of words that a task holds; sentences whose steps of an epoch take as long as a turn's job does
#: besides; changes of a word in one step; numbers of a pack's vectors, and words of its sentences.
HELD, DEALT, TOUCHED, PACKED, PLACED = 1 << 24, 16_000, 32, 1 << 12, 1 << 15
#: Numbers of the vectors of a task that ask for neighbours; rows and queries that are compared at a time.
ASKED, TILE, BLOCK = 1 << 21, 1024, 256
_STATE = "kind int, block int, at long, turn int, first binary, second binary, vec binary"
_NAMES = ["kind", "block", "at", "turn", "first", "second", "vec"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_WORDS, _TERMS, _SENTENCES = range(3)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(draws: np.ndarray, *numbers: int) -> np.ndarray:
    """A stream of random numbers for each of draws, another one for other numbers."""
    keys = draws.astype(np.uint64)
    for n in numbers:
        keys = _mixed(keys * _GOLDEN + np.uint64(n + 1))
    return keys


def _uniform(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n-th numbers, from 0 to 1, of the streams."""
    return (_mixed(keys + (n.astype(np.uint64) + np.uint64(1)) * _GOLDEN) >> np.uint64(11)) * 2.0**-53


def start(draws: np.ndarray, size: int, seed: int) -> np.ndarray:
    return (_uniform(_keys(draws, seed)[:, None], np.arange(size)) - 0.5) / size


class Drawn:
    """Places, drawn in proportion to chance: a table says where to begin to look."""

    def __init__(self, chance: np.ndarray) -> None:
        self.bounds = np.cumsum(chance)
        self.begin = np.searchsorted(self.bounds, np.arange(4 * len(chance)) * (self.bounds[-1] / (4 * len(chance))))

    def __call__(self, u: np.ndarray) -> np.ndarray:
        flat = u.ravel()
        at, x = self.begin[(flat * len(self.begin)).astype(np.int64)], flat * self.bounds[-1]
        more = np.flatnonzero(self.bounds[at] < x)
        while len(more):
            at[more] += 1
            more = more[self.bounds[at[more]] < x[more]]
        return at.reshape(u.shape)


def _stepped(vectors: np.ndarray, output: np.ndarray, owner: np.ndarray, at: np.ndarray, rate: float, learn: bool) -> None:
    """One step of sentences: `at` has a row for each word of theirs, towards the first of `output`, away from the others."""
    known, own = output.take(at, axis=0), vectors.take(owner, axis=0)
    error = 1 / (1 + np.exp(-np.clip(np.einsum("tks,ts->tk", known, own), -30, 30)))
    error[:, 0] -= 1
    error *= -rate
    firsts = np.flatnonzero(np.diff(owner, prepend=-1))
    vectors[owner[firsts]] += np.add.reduceat(np.einsum("tk,tks->ts", error, known), firsts)
    if learn:
        size = output.shape[1]
        cells = at[:, :, None] * size + np.arange(size)
        np.add.at(output.reshape(-1), cells.ravel(), (error[:, :, None] * own[:, None, :]).ravel())  # fast for one dimension only


def _together(chance: np.ndarray, sentences: int, negative: int) -> int:
    """How many sentences a step takes: see TOUCHED. chance: of a block's words, their counts to the power of 0.75."""
    counts = chance ** (4 / 3)
    touched = (counts + negative * counts.sum() * chance / chance.sum()).max() / max(sentences, 1)
    return max(1, int(TOUCHED / touched))


def _met(settings: dict, epochs: list[int], turn: int, learn: bool):
    """Rows of the state in one partition: a block of words in order, then packs of sentences, each after its terms."""
    size, negative = settings["size"], settings["negative"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, output, drawn, together, terms = [], None, None, 1, None

        def gathered() -> None:
            nonlocal output, drawn, together
            if len({w["block"] for w in words}) > 1:
                raise ValueError("blocks of words share a partition")
            output = np.concatenate([np.frombuffer(w["vec"], np.float32) for w in words]).astype(float).reshape(-1, size)
            chance = np.concatenate([np.frombuffer(w["first"]) for w in words])
            drawn, together = Drawn(chance), _together(chance, settings["sentences"], negative) if learn else 1

        def learned(vectors: np.ndarray, draws: np.ndarray) -> None:
            places, counts = terms
            owner = np.repeat(np.arange(len(counts)), counts)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            nth = nth[:, None] * negative + np.arange(negative)
            ends = np.concatenate(([0], np.cumsum(counts)))
            take = together if learn else len(counts)
            for epoch in epochs:
                u = _uniform(_keys(draws, settings["seed"], epoch, turn)[owner][:, None], nth)
                at, rate = np.concatenate((places[:, None], drawn(u)), axis=1), settings["rate"] * (1 - epoch / settings["epochs"])
                for i in range(0, len(counts), take):
                    lo, hi = ends[i], ends[min(i + take, len(counts))]
                    if hi > lo:
                        _stepped(vectors, output, owner[lo:hi], at[lo:hi], rate, learn)

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["kind"] == _WORDS:
                    words.append(row)
                    continue
                if output is None and words:
                    gathered()
                if row["kind"] == _TERMS:
                    terms = np.frombuffer(row["first"], np.int32), np.frombuffer(row["second"], np.int32)
                    continue
                if terms is not None:
                    vectors = np.frombuffer(row["vec"], np.float32).astype(float).reshape(-1, size)
                    learned(vectors, np.frombuffer(row["second"], np.int64))
                    row["vec"], terms = vectors.astype(np.float32).tobytes(), None
                out.append(row)
            yield _packs(out)
        if learn and output is None:
            yield _packs(words)
        elif learn:
            ends = np.cumsum([len(w["first"]) // 8 for w in words])
            parts = np.split(output.astype(np.float32), ends[:-1])
            yield _packs([w | {"vec": p.tobytes()} for w, p in zip(words, parts, strict=True)])

    return run


def _packs(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)


def _words_packed(size: int):
    """Packs of (block, at, chance, vec), which come in order of (block, at)."""
    most = max(1, PACKED // size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks, at, chance = (b.column(c).to_numpy() for c in ("block", "at", "chance"))
            vectors = b.column("vec").flatten().to_numpy().reshape(-1, size)
            cuts = np.flatnonzero(np.diff(blocks, prepend=-1))
            out = []
            for lo, hi in zip(cuts, [*cuts[1:], len(at)], strict=True):
                for i in range(lo, hi, most):
                    k = min(i + most, hi)
                    out.append({"kind": _WORDS, "block": int(blocks[i]), "at": int(at[i]), "turn": None, "first": chance[i:k].tobytes(), "second": None, "vec": vectors[i:k].tobytes()})
            yield _packs(out)

    return run


def _sentences_packed(size: int, seed: int, blocks: int, turned: bool):
    """Packs of (block, at, draw, terms), all of one block in a partition, and for every block of words their places in it."""
    most = max(1, PACKED // size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = 0
        for b in batches:
            own, at, draws = (b.column(c).to_numpy() for c in ("block", "at", "draw"))
            counts = pc.fill_null(pc.list_value_length(b.column("terms")), 0).to_numpy()
            terms = b.column("terms").flatten()
            block, place = (terms.field(c).to_numpy() for c in ("block", "at"))
            ends = np.concatenate(([0], np.cumsum(counts)))
            vectors = start(draws, size, seed).astype(np.float32)
            i, out = 0, []
            while i < len(at):
                k = min(i + most, len(at), max(i + 1, int(np.searchsorted(ends, ends[i] + PLACED, "right")) - 1))
                k = i + int((own[i:k] == own[i]).sum())
                base = {"block": int(own[i]), "at": pack}
                out.append({"kind": _SENTENCES, **base, "turn": None, "first": at[i:k].tobytes(), "second": draws[i:k].tobytes(), "vec": vectors[i:k].tobytes()})
                their, places, owner = block[ends[i] : ends[k]], place[ends[i] : ends[k]], np.repeat(np.arange(k - i), counts[i:k])
                for j in np.unique(their).tolist():
                    some = their == j
                    sizes = np.bincount(owner[some], minlength=k - i).astype(np.int32)
                    out.append({"kind": _TERMS, **base, "turn": (j - int(own[i])) % blocks if turned else j, "first": places[some].astype(np.int32).tobytes(), "second": sizes.tobytes(), "vec": None})
                i, pack = k, pack + 1
            yield _packs(out)

    return run


def _unpacked(size: int):
    """(block, at, vec) of packs of words, whose places count on from the first one, or of sentences, which are listed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                vec = np.frombuffer(row["vec"], np.float32)
                n = len(vec) // size
                at = row["at"] + np.arange(n) if row["kind"] == _WORDS else np.frombuffer(row["first"], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(vec))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["block"], np.int32)), pa.array(at), lists], names=["block", "at", "vec"])

    return run


def _dealt(words: DataFrame, blocks: int) -> DataFrame:
    """words with their block and their place in it; a block is bounded by HELD."""
    words = words.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int"))
    return words.withColumn("at", (F.row_number().over(Window.partitionBy("block").orderBy("word")) - 1).cast("long"))


class DocVectors:
    """words: (word, chance, vec), and the settings of the fit; fitted: (id, vec) of the sentences that were fitted."""

    def __init__(self, words: DataFrame, settings: dict, fitted: DataFrame | None = None) -> None:
        self.words, self.settings, self.fitted = words, settings, fitted

    @classmethod
    def fit(cls, sentences: DataFrame, size: int = 512, min_count: int = 2, epochs: int = 40, rate: float = 0.05, negative: int = 5, seed: int = 1, blocks: int | None = None) -> DocVectors:
        """Fit on all of sentences (id, tokens). Words below min_count aren't learned. Empty or null tokens leave a
        sentence where it starts; repeated rows count as often as they occur. The same rows and seed give the same vectors."""
        spark = sentences.sparkSession
        counts = sentences.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
        counts, total = stored(counts, "doc-words"), sentences.count()
        if blocks is None:
            by_size = math.ceil(counts.count() * size / HELD)
            blocks = max(1, by_size, min(spark.sparkContext.defaultParallelism, math.ceil(math.sqrt(total / DEALT))))
        words = counts.select("word", F.pow("n", F.lit(0.75)).alias("chance"), F.array_repeat(F.lit(0.0), size).cast("array<float>").alias("vec"))
        settings = {"size": size, "epochs": epochs, "rate": rate, "negative": negative, "seed": seed, "blocks": blocks, "sentences": total}
        with temporary(spark) as kept:
            dealt = stored(_dealt(words, blocks), "doc-vocabulary")
            rows, packs = cls._packed(sentences, dealt, settings, blocks, blocks, True)
            state = packs.where(F.col("kind") == _SENTENCES).unionByName(cls._words(dealt, size, blocks))
            path, n = scratch(spark, "doc-state"), 0
            for epoch in range(epochs):
                for turn in range(blocks):
                    terms = packs.where((F.col("kind") == _TERMS) & (F.col("turn") == turn))
                    meets = F.when(F.col("kind") == _WORDS, F.pmod(F.col("block") - turn, F.lit(blocks))).otherwise(F.col("block"))
                    state = cls._meeting(state.unionByName(terms), meets, blocks).mapInArrow(_met(settings, [epoch], turn, True), _STATE)
                state.write.parquet(f"{path}/{n + 1}")
                removed(spark, f"{path}/{n}")
                n += 1
                state = spark.read.schema(_STATE).parquet(f"{path}/{n}")
            learned = state.where(F.col("kind") == _WORDS).mapInArrow(_unpacked(size), "block int, at long, vec array<float>")
            learned = kept(dealt.drop("vec").join(learned, ["block", "at"]).select("word", "chance", "vec"), "doc-words")
            vectors = kept(cls._named(rows, state, size), "doc-vectors")
            removed(spark, path)
        return cls(learned, settings, vectors)

    @staticmethod
    def _meeting(state: DataFrame, meets: Column, parts: int) -> DataFrame:
        dealt = state.repartitionById(parts, meets)
        return dealt.sortWithinPartitions(F.col("kind") != _WORDS, "at", "kind").select(*_NAMES)

    @staticmethod
    def _words(dealt: DataFrame, size: int, blocks: int) -> DataFrame:
        rows = dealt.select("block", "at", "chance", "vec").repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "at")
        return rows.mapInArrow(_words_packed(size), _STATE)

    @staticmethod
    def _packed(sentences: DataFrame, dealt: DataFrame, settings: dict, parts: int, blocks: int, turned: bool) -> tuple[DataFrame, DataFrame]:
        """(id, at) of the sentences, and their packs in so many parts, by kind and turn, or block of words."""
        spark = sentences.sparkSession
        at, draw = F.monotonically_increasing_id().alias("at"), F.crc32(F.concat_ws(" ", "tokens").cast("binary")).alias("draw")
        rows = stored(sentences.select("id", "tokens", at, draw), "doc-sentences")
        terms = rows.select("at", F.posexplode("tokens").alias("place", "word")).join(dealt.select("word", "block", F.col("at").alias("w")), "word")
        terms = terms.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("place", "block", F.col("w").alias("at")))).alias("terms"))
        block, spread = F.pmod(F.xxhash64("at"), F.lit(parts)).cast("int").alias("block"), F.xxhash64("at", F.lit("order"))
        own = rows.select("at", "draw", block).join(terms, "at", "left").repartitionById(parts, F.col("block"))
        own = own.sortWithinPartitions("block", spread, "at")  # copies that stand together are spread
        packs = own.mapInArrow(_sentences_packed(settings["size"], settings["seed"], blocks, turned), _STATE)
        return rows.select("id", "at"), stored(packs, "doc-packs", "kind", "turn").select(*_NAMES)

    @staticmethod
    def _named(rows: DataFrame, state: DataFrame, size: int) -> DataFrame:
        found = state.where(F.col("kind") == _SENTENCES).mapInArrow(_unpacked(size), "block int, at long, vec array<float>")
        return rows.join(found, "at").select("id", "vec")

    def vectors(self, sentences: DataFrame) -> DataFrame:
        """(id, vec) of sentences (id, tokens), seen or not; without known words a vector stays where it starts."""
        spark, s = sentences.sparkSession, self.settings
        size, parts = s["size"], spark.sparkContext.defaultParallelism
        with temporary(spark) as kept:
            blocks = max(1, math.ceil(self.words.count() * size / HELD))
            dealt = stored(_dealt(self.words.select("word", "chance", "vec"), blocks), "doc-vocabulary")
            rows, packs = self._packed(sentences, dealt, s, parts, blocks, False)
            words = stored(self._words(dealt, size, blocks), "doc-words")
            state, path, n = packs.where(F.col("kind") == _SENTENCES), scratch(spark, "doc-state"), 0
            every = list(range(s["epochs"]))
            for epochs in [every] if blocks == 1 else [[e] for e in every]:
                for turn in range(blocks):
                    terms = packs.where((F.col("kind") == _TERMS) & (F.col("turn") == turn)).unionByName(state)
                    met = words.where(F.col("block") == turn).withColumn("meets", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
                    met = met.unionByName(terms.withColumn("meets", F.col("block")))
                    state = self._meeting(met, F.col("meets"), parts).mapInArrow(_met(s, epochs, turn, False), _STATE)
                state.write.parquet(f"{path}/{n + 1}")
                removed(spark, f"{path}/{n}")
                n += 1
                state = spark.read.schema(_STATE).parquet(f"{path}/{n}")
            vectors = kept(self._named(rows, state, size), "doc-vectors")
            removed(spark, path)
        return vectors

    def save(self, path: str) -> None:
        self.words.withColumn("settings", F.lit(json.dumps(self.settings))).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> DocVectors:
        words = spark.read.parquet(path)
        one = words.select("settings").first()
        if one is None:
            raise ValueError(f"{path} holds no word")
        return cls(words.drop("settings"), json.loads(one["settings"]))


def neighbour_share(vectors: DataFrame, topics: DataFrame, every: int = 20) -> DataFrame:
    """(queries, same, chance): of the rows whose id is divisible by `every`, how many have a nearest other row, by
    cosine, of their own topic, and how many would by chance. vectors: (id, vec), topics: (id, topic).

    Exact: every row is compared with every query, in tiles: a task holds a block of queries, and a share of the rows
    streams past it; it keeps one best row a query. The work is that of all pairs, the memory that of a block.
    """
    named = stored(vectors.join(topics.where(F.col("topic").isNotNull()), "id").select("id", "topic", "vec"), "neighbours")
    asked = named.where(F.col("id") % every == 0)
    first, total = named.select(F.size("vec")).first(), named.count()
    width = first[0] if first else 1
    tall = max(1, math.ceil(asked.count() * width / ASKED))
    wide = max(1, math.ceil(2 * named.sparkSession.sparkContext.defaultParallelism / tall))
    every_tall, every_wide = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (tall, wide))
    left = asked.select(F.pmod(F.xxhash64("id"), F.lit(tall)).alias("t"), every_wide.alias("w"), F.lit(0).alias("kind"), "id", F.lit(None).cast("string").alias("topic"), "vec")
    right = named.select(every_tall.alias("t"), F.pmod(F.xxhash64("id", F.lit("row")), F.lit(wide)).alias("w"), F.lit(1).alias("kind"), "id", F.col("topic").cast("string").alias("topic"), "vec")
    dealt = left.unionByName(right).withColumn("tile", (F.col("t") * wide + F.col("w")).cast("int"))
    dealt = dealt.repartitionById(tall * wide, "tile").sortWithinPartitions("kind", "id").select("kind", "id", "topic", "vec")
    best = dealt.mapInArrow(_nearest(width), "query long, id long, topic string, cosine double")
    ranked = best.groupBy("query").agg(F.max_by("topic", F.struct("cosine", -F.col("id"))).alias("found"))
    sizes = named.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    joined = ranked.join(asked.select(F.col("id").alias("query"), "topic"), "query").join(sizes, "topic")
    return joined.agg(F.count(F.lit(1)).alias("queries"), F.avg((F.col("found") == F.col("topic")).cast("double")).alias("same"), F.avg((F.col("n") - 1) / (total - 1)).alias("chance"))


def _nearest(width: int):
    """Rows of a tile: queries, then rows that they are compared with, both in order of id."""

    def directions(b: pa.RecordBatch, rows: np.ndarray) -> np.ndarray:
        x = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)[rows]
        return x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, names, q, ids = [], [], None, None
        for b in batches:
            kinds, own = b.column("kind").to_numpy(), b.column("id").to_numpy()
            split = int(np.searchsorted(kinds, 1))
            if split:
                names.append(own[:split])
                blocks.append(directions(b, np.arange(split)))
            if split == len(kinds) or not blocks:
                continue
            if q is None:
                q, ids, blocks = np.concatenate(blocks), np.concatenate(names), [None]
                best, found = np.full(len(q), -2.0), np.zeros(len(q), np.int64)
                topic = np.full(len(q), None, object)
            rows = np.arange(split, len(kinds))
            x, own, theirs = directions(b, rows), own[split:], b.column("topic").to_numpy(zero_copy_only=False)[split:]
            low, high = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
            for i in range(0, len(own), TILE):
                cols, asks = x[i : i + TILE].T, np.flatnonzero(high[i : i + TILE] > low[i : i + TILE])
                begins, ends = low[i : i + TILE][asks], high[i : i + TILE][asks]
                for lo in range(0, len(q), BLOCK):
                    hi = min(lo + BLOCK, len(q))
                    cosine = q[lo:hi] @ cols
                    for k in np.flatnonzero((begins < hi) & (ends > lo)):  # no row is its own neighbour
                        cosine[max(begins[k] - lo, 0) : ends[k] - lo, asks[k]] = -2.0
                    top = cosine.max(axis=1)
                    new = np.flatnonzero(top > best[lo:hi])  # rows come in order of id, so the first of equal ones stays
                    if len(new):
                        at = i + cosine[new].argmax(axis=1)
                        best[lo + new], found[lo + new], topic[lo + new] = top[new], own[at], theirs[at]
        if q is not None:
            some = best > -2.0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(found[some]), pa.array(topic[some].tolist(), pa.string()), pa.array(best[some])], names=["query", "id", "topic", "cosine"])

    return run
