"""Scoring by a hierarchical Pitman-Yor language model.

Every token is a customer of the restaurant of its context, the previous word. Context restaurants share
one parent, the restaurant of all words: each table of a context sends a customer there, and its tables
draw from the uniform base measure. A text's score is the sum of log10 of its tokens' predictive
probabilities, averaged over SAMPLES seatings.

Seating is sampled by Gibbs, a sweep over all dishes (pairs of word and context) at a time: of each dish,
the number of its tables is drawn given all totals after the sweep before. Which customer sits at which
table is summed out exactly, by generalised Stirling numbers: c customers have t tables in proportion to
S(c, t) times, for each table in turn, (concentration + discount * tables of the restaurant by then) * the
parent's probability. The parent's tables are drawn in the same way. For a dish with more than EXACT
customers a particle filter goes on from there, in blocks of 1/16 of those seated.

Contexts are hashed to CONTEXTS restaurants, so that the totals of all contexts are two vectors of a
fixed size that every task can hold; all tokens of all training texts are seated.

Plan
1. One pass counts tokens, context totals and words so frequent that they need several buckets.
2. A second pass turns a run of texts (a chunk) into its distinct (word, context) pairs with the texts
   they occur in, and deals them by word to buckets of a bounded number of tokens; a frequent word's pairs
   are dealt by context as well. This exchange, about the size of the input, is the only one of that size.
   It is written to the shared folder, a row for each bucket.
3. A sweep is one pass over the buckets. Words are whole in a bucket, so the parent's customers of a word
   are local; tables by context, those of frequent words and the parent's totals are summed over all
   buckets after each sweep, and the next one is given the sums and the tables that the one before has written.
4. A last pass over the first table, which has the texts too, repeats all sweeps from their sums and seeds and
   returns the sums of log-probabilities by text, added up by chunk. So texts are not written again by sweeps.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from contextlib import ExitStack
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, stored, table, temporary

#: Restaurants of contexts: 2 to the power of BITS.
BITS = 17
CONTEXTS = 1 << BITS
#: Gibbs sweeps before the first sample, and samples (one sweep apart).
BURN_IN, SAMPLES = 2, 2
#: Concentrations of the context restaurants and of their parent; discounts are estimated from counts of counts.
CONCENTRATION, ROOT_CONCENTRATION = 1.0, 1.0
#: Tokens and texts of a chunk at most; tokens of a bucket, about.
CHUNK, CHUNK_TEXTS, BUCKET = 1 << 20, 60_000, 500_000
#: Buckets at least. Their number hangs on the tokens alone, and so do random numbers, which are drawn by bucket.
BUCKETS = 64
#: Customers of one dish in one restaurant whose number of tables is drawn exactly, and particles for larger dishes.
EXACT, PARTICLES = 1024, 32
#: Words that a worker remembers.
REMEMBERED = 200_000
_END, _START = b" end", b" start"  # no word has a space
#: Contexts whose totals travel together, and groups of tasks that are added up first.
_BLOCK, _FANIN = CONTEXTS >> 3, 32


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


def _context(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)) % np.uint64(CONTEXTS)).astype(np.uint32)


class _Words(dict):
    """Numbers of words in the order they come; hashes by number."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes: list[int] = []
        self[_END], self[_START]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(_hash(word))
        return n


def _tokens(text: str | None, words: _Words) -> np.ndarray:
    found = (text or "").encode().lower().split()
    found.append(_END)
    return np.fromiter(map(words.__getitem__, found), np.int32, len(found))


def _pack(*arrays: np.ndarray) -> bytes:
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        out += [struct.pack("<2sq", a.dtype.str[1:].encode(), len(a)), a.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(data: bytes) -> list[np.ndarray]:
    """The arrays of _pack. They are compressed there, so that shuffle, sort and files hold the small form only."""
    data = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 1
    for _ in range(data[0]):
        kind, n = struct.unpack_from("<2sq", data, at)
        out.append(np.frombuffer(data, np.dtype("<" + kind.decode()), n, at + 10))
        at += 10 + out[-1].nbytes
    return out


# -- 1: totals -----------------------------------------------------------------------------------


def _survey(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: tokens, training tokens; 1: a block of context totals; 2: a frequent word and its tokens."""
    words, counts, contexts, tokens, trained = _Words(), np.zeros(0, np.int64), np.zeros(CONTEXTS, np.int64), 0, 0
    frequent: dict[int, int] = {}

    def fold() -> None:
        for i in np.flatnonzero(counts >= max(2, counts.sum() // 20_000)).tolist():
            frequent[words.hashes[i]] = frequent.get(words.hashes[i], 0) + int(counts[i])

    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            b = batch.slice(i, 512)
            texts = [_tokens(text, words) for text in b.column(0).to_pylist()]
            sizes = np.array([len(t) for t in texts])
            found = np.concatenate(texts)
            now = np.bincount(found, minlength=len(words))
            now[: len(counts)] += counts
            counts = now
            train = np.repeat(~np.array(b.column(1).to_pylist(), bool), sizes)
            before = np.concatenate(([1], found[:-1]))
            before[np.cumsum(sizes) - sizes] = 1
            contexts += np.bincount(_context(np.array(words.hashes, np.uint64))[before[train]], minlength=CONTEXTS)
            tokens, trained = tokens + len(found), trained + int(train.sum())
            if len(words) > REMEMBERED:
                fold()
                words, counts = _Words(), np.zeros(0, np.int64)
    fold()
    yield _totals([tokens, trained], contexts[None], frequent)


def _totals(sums, by_context: np.ndarray, frequent: dict) -> pa.RecordBatch:
    """Rows of a task: kind 0, sums; 1, totals by context in blocks, a row of by_context after the other; 2, numbers of
    frequent words, with the first also as n."""
    rows = [(0, 0, 0, np.array(sums))]
    for s, row in enumerate(by_context):
        rows += [(1, s * CONTEXTS + i, 0, row[i : i + _BLOCK]) for i in range(0, CONTEXTS, _BLOCK)]
    rows += [(2, h - (1 << 63), int(np.atleast_1d(n)[0]), np.atleast_1d(n)) for h, n in frequent.items()]
    kind, key, n, value = zip(*rows, strict=True)
    arrays = pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array([v.astype("<i8").tobytes() for v in value], pa.binary())
    return pa.RecordBatch.from_arrays(list(arrays), names=["kind", "key", "n", "value"])


_TOTALS = "kind int, key long, n long, value binary"


def _add(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v, "<i8") for v in rows["value"].to_pylist())
    n = sum(rows["n"].to_pylist())
    return pa.table({"kind": rows["kind"][:1], "key": rows["key"][:1], "n": pa.array([n], pa.int64()), "value": pa.array([total.tobytes()], pa.binary())})


def _added(rows: DataFrame) -> DataFrame:
    """Totals over all tasks, in two steps, so that no task adds up what every other has sent."""
    some = rows.withColumn("tasks", F.pmod(F.spark_partition_id(), F.lit(_FANIN))).groupBy("kind", "key", "tasks")
    first = some.applyInArrow(_add, _TOTALS)
    return first.groupBy("kind", "key").applyInArrow(_add, _TOTALS)


# -- 2: pairs by bucket --------------------------------------------------------------------------


def _deal(buckets: int, salts: dict[int, int], id_type: pa.DataType):
    names = ["bucket", "chunk", "blob", "ids", "held", "sizes"]

    def chunk_rows(chunk: int, texts: list[tuple], words: _Words) -> Iterator[pa.RecordBatch]:
        texts = sorted(texts, key=lambda t: t[1])  # training texts first
        trained = sum(not t[1] for t in texts)
        sizes = [len(t[2]) for t in texts]
        flat = pa.RecordBatch.from_arrays(
            [pa.array([-1 - chunk], pa.int64()), pa.array([chunk], pa.int64()), pa.array([None], pa.binary()), pa.array([[t[0] for t in texts]], pa.list_(id_type)), pa.array([[t[1] for t in texts]], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int64()))],
            names=names,
        )
        yield flat
        token = np.concatenate([t[2] for t in texts])
        at = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
        before = np.concatenate(([1], token[:-1]))
        before[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = 1
        hashes = np.array(words.hashes, np.uint64)
        context = _context(hashes)[before]
        salt = np.ones(len(hashes), np.uint64)
        for i in np.flatnonzero(np.isin(hashes, np.fromiter(salts, np.uint64, len(salts)))).tolist() if salts else []:
            salt[i] = salts[words.hashes[i]]
        bucket = (hashes[token] + (context % salt[token]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)
        bucket = (bucket % np.uint64(buckets)).astype(np.int64)
        key = token.astype(np.int64) << BITS | context
        order = np.argsort(key, kind="stable")  # texts stay in order in a pair
        order = order[np.argsort(bucket[order], kind="stable")]
        key, at, bucket = key[order], at[order], bucket[order]
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (at[1:] != at[:-1]))))
        n = np.diff(np.append(first, len(key)))
        key, at, bucket = key[first], at[first].astype(np.uint16), bucket[first]
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))  # first text of each pair, which has one bucket
        texts_of, pair, home = np.diff(np.append(edge, len(key))), key[edge], bucket[edge]
        ends = np.flatnonzero(np.diff(np.append(home, -1))) + 1
        start, out = 0, ([], [])
        for end in ends.tolist():
            part = pair[start:end]
            word = part >> BITS
            lead = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            a, b = edge[start], edge[end] if end < len(edge) else len(key)
            count = n[a:b]
            out[0].append(int(home[start]))
            out[1].append(_pack(
                np.array([chunk, len(texts), trained]), hashes[word[lead]], np.diff(np.append(lead, len(part))).astype(np.uint16 if len(lead) > 1 else np.uint32),
                (part & (CONTEXTS - 1)).astype(np.uint32), texts_of[start:end].astype(np.uint16), at[a:b], count.astype(np.uint8 if count.max() < 256 else np.uint32),
            ))
            start = end
        k = len(out[0])
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array([chunk] * k, pa.int64()), pa.array(out[1], pa.binary()), pa.nulls(k, pa.list_(id_type)), pa.nulls(k, pa.list_(pa.bool_())), pa.nulls(k, pa.list_(pa.int64()))], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, texts, size, words = TaskContext.get().partitionId() << 24, [], 0, _Words()
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                for doc, text, held in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    found = _tokens(text, words)
                    texts.append((doc, held, found))
                    size += len(found)
                    if size >= CHUNK or len(texts) >= CHUNK_TEXTS:
                        yield from chunk_rows(chunk, texts, words)
                        chunk, texts, size, words = chunk + 1, [], 0, _Words()
        if texts:
            yield from chunk_rows(chunk, texts, words)

    return run


class Bucket:
    """The pairs of one bucket, merged over chunks.

    words: hashes; word, context, count by pair; place: the pair of each chunk's pairs, in order; parts: by chunk, its
    number, texts and training texts, then the number of texts of each of its pairs, those texts, and the tokens in each.
    """

    FIELDS = ("words", "word", "context", "count", "place", "meta", "texts", "at", "n")
    SEATED = 4

    def __init__(self, *arrays: np.ndarray) -> None:
        for name, a in zip(self.FIELDS, arrays):  # noqa: B905  seating needs the first SEATED only
            setattr(self, name, a)

    @classmethod
    def merged(cls, blobs: Iterable[bytes]) -> Bucket:
        parts = [_unpack(b) for b in blobs]
        words, word = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        key = np.repeat(word.astype(np.int64), np.concatenate([p[2] for p in parts])) << BITS
        key |= np.concatenate([p[3] for p in parts])
        pairs, place = np.unique(key, return_inverse=True)
        del key
        sums, meta = [], []
        for m, _, _, own, texts, at, n in parts:
            edge = np.cumsum(texts, dtype=np.int64) - texts
            sums.append(np.add.reduceat(np.where(at < m[2], n, 0).astype(np.int64), edge))
            meta += [*m.tolist(), len(own), len(at)]
        count = np.bincount(place, np.concatenate(sums), len(pairs)).astype(np.uint32)
        joined = [np.concatenate([p[i] for p in parts]) for i in (4, 5, 6)]
        return cls(words, (pairs >> BITS).astype(np.uint32), (pairs & (CONTEXTS - 1)).astype(np.uint32), count, place.astype(np.uint32), np.array(meta), *joined)

    def dump(self) -> tuple[bytes, bytes]:
        """What seating needs, and the rest."""
        return tuple(_pack(*(getattr(self, name) for name in part)) for part in (self.FIELDS[: self.SEATED], self.FIELDS[self.SEATED :]))

    def parts(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each chunk: number, texts; and by text of a pair: pair, text, tokens."""
        i = j = 0
        for chunk, n_texts, _, pairs, entries in self.meta.reshape(-1, 5).tolist():
            pair = np.repeat(self.place[i : i + pairs], self.texts[i : i + pairs])
            yield chunk, n_texts, pair, self.at[j : j + entries], self.n[j : j + entries]
            i, j = i + pairs, j + entries

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.word, self.count, len(self.words)).astype(np.int64)


def _gather(frequent: frozenset[int]):
    """One row for each bucket: its blobs, pairs by context, and sums over its pairs and words."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        names = ["bucket", "chunk", "ids", "held", "sizes", "state", "texts", "pairs", "sums", "frequent"]
        kinds = pa.int64(), pa.int64(), rows.schema.field("ids").type, pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()
        if key[0].as_py() < 0:
            first = [rows[c][0].as_py() for c in ("bucket", "chunk", "ids", "held", "sizes")]
            return pa.table([pa.array([v], k) for v, k in zip([*first, *[None] * 5], kinds, strict=True)], names=names)
        b = Bucket.merged(rows["blob"].to_pylist())
        seen = b.count > 0
        pairs = np.bincount(b.context[seen], minlength=CONTEXTS)
        counts, types = b.word_counts(), np.bincount(b.word[seen], minlength=len(b.words))
        often = np.isin(b.words, np.fromiter(frequent, np.uint64, len(frequent)))
        once, twice = (int((b.count == k).sum()) for k in (1, 2))
        one, two = (int((types[~often] == k).sum()) for k in (1, 2))
        sums = [int((counts[~often] > 0).sum()), once, twice, one, two, int(counts.sum()), int(seen.sum())]
        values = [key[0].as_py(), None, None, None, None, *b.dump(), _pack(pairs.astype("<u4")), sums, _pack(b.words[often], counts[often], types[often])]
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    return run


# -- 3: seating ----------------------------------------------------------------------------------


class Tables:
    """Draws numbers of tables of dishes: t of c customers in proportion to S(c, t) times the weights of t new tables,
    that of one being base * (concentration + discount * tables there), `others` of which are of other dishes."""

    def __init__(self, discount: float, concentration: float) -> None:
        self.discount, self.concentration = discount, concentration
        self.log_s = [np.zeros(0), np.zeros(1)]  # by customers, from one table on

    def log_stirling(self, c: int) -> np.ndarray:
        """log S(c, t) for t = 1..c: S(n + 1, t) = S(n, t - 1) + (n - discount * t) * S(n, t)."""
        while len(self.log_s) <= c:
            last = self.log_s[-1]
            n = len(last)
            stay = np.append(last + np.log(n - self.discount * np.arange(1, n + 1)), -np.inf)
            self.log_s.append(np.logaddexp(stay, np.append(-np.inf, last)))
        return self.log_s[c]

    def new(self, base: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Weight of a new table where there are so many."""
        return base * (self.concentration + self.discount * tables)

    def exact(self, c: int, base: np.ndarray, others: np.ndarray, rng: np.random.Generator, each: int = 1) -> np.ndarray:
        """`each` draws for each of dishes with c customers."""
        p = np.log(self.new(base[:, None], others[:, None] + np.arange(c)))
        p = np.cumsum(p, axis=1) + self.log_stirling(c)
        p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
        return 1 + np.stack([(p < rng.random(len(base))[:, None] * p[:, -1:]).sum(axis=1) for _ in range(each)], axis=1)

    def draw(self, count: np.ndarray, base: np.ndarray, others: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Tables of dishes with so many customers, one at least."""
        tables = np.minimum(count, 1).astype(float)
        two = np.flatnonzero(count == 2)
        weight = self.new(base[two], others[two] + 1)
        tables[two] += rng.random(len(two)) * (weight + 1 - self.discount) < weight
        some = np.flatnonzero((count > 2) & (count <= EXACT))
        some = some[np.argsort(count[some], kind="stable")]
        for group in np.split(some, np.flatnonzero(np.diff(count[some])) + 1) if len(some) else []:
            c = int(count[group[0]])
            rows = max(1, (1 << 18) // c)
            for i in range(0, len(group), rows):
                at = group[i : i + rows]
                tables[at] = self.exact(c, base[at], others[at], rng)[:, 0]
        many = np.flatnonzero(count > EXACT)
        if len(many):
            tables[many] = self.filtered(count[many], base[many], others[many], rng)
        return tables

    def filtered(self, count: np.ndarray, base: np.ndarray, others: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """As draw, for dishes with more than EXACT customers: PARTICLES exact draws for the first EXACT, then blocks of
        1/16 of those seated; after each, particles are drawn anew by the weight of what they have seated."""
        t = self.exact(EXACT, base, others, rng, PARTICLES).astype(float)
        seated, base, others = np.full(len(count), EXACT), base[:, None], others[:, None]
        while (seated < count).any():
            block = np.minimum(seated // 16, count - seated)
            weight = self.new(base, others + t)
            norm = (seated + block / 2)[:, None] - self.discount * t + weight
            t = t + rng.binomial(block[:, None], np.clip(weight / norm, 0, 1))
            heavy = block[:, None] * np.log(norm)
            heavy = np.cumsum(np.exp(heavy - heavy.max(axis=1, keepdims=True)), axis=1)
            upto = np.floor(heavy / heavy[:, -1:] * PARTICLES + rng.random((len(count), 1))).astype(np.int64)  # systematic
            upto[:, -1] = PARTICLES
            t = np.repeat(t.ravel(), np.diff(upto, axis=1, prepend=0).ravel()).reshape(t.shape)
            seated = seated + block
        return t[np.arange(len(t)), rng.integers(0, PARTICLES, len(t))]


@lru_cache(4)
def _drawing(discount: float, concentration: float) -> Tables:
    """One per worker, as its Stirling numbers serve all buckets."""
    return Tables(discount, concentration)


class Model:
    """What all buckets know: counts, discounts, totals by context, and the totals after each sweep so far.

    sums: of each sweep, from the start with one table of each dish: tables (by context), total and root (the parent's
    customers and tables), frequent (those of each frequent word).
    """

    def __init__(self, n: int, vocabulary: int, contexts: np.ndarray, discounts: tuple[float, float], frequent: dict[int, int], start: dict, seed: int, burn_in: int, samples: int) -> None:
        self.n, self.vocabulary, self.contexts, self.discounts, self.frequent, self.seed = n, vocabulary, contexts, discounts, frequent, seed
        self.burn_in, self.samples, self.sums = burn_in, samples, [start]

    def new_root(self, sums: dict) -> float:
        """Weight of a new table of a word in the parent."""
        return (ROOT_CONCENTRATION + self.discounts[1] * sums["root"]) / (self.vocabulary + 1)

    def first(self, b: Bucket) -> tuple[np.ndarray, np.ndarray]:
        """Before any sweep: one table of each pair seen, and one of the parent for each word."""
        seen = b.count > 0
        return np.ones(int(seen.sum())), np.minimum(np.bincount(b.word[seen], minlength=len(b.words)), 1.0)

    def sweep(self, k: int, bucket: int, b: Bucket, drawn: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tables of the pairs seen, and of the parent by word, after the k-th sweep from those before it."""
        sums, rng = self.sums[k], np.random.default_rng([self.seed, bucket + 1, k])
        seen = np.flatnonzero(b.count > 0)
        word = b.word[seen]
        dishes, roots = _drawing(self.discounts[0], CONCENTRATION), _drawing(self.discounts[1], ROOT_CONCENTRATION)
        parent = self.parent(sums, b.words, np.bincount(word, drawn, len(b.words)), root)
        drawn = dishes.draw(b.count[seen].astype(np.int64), parent[word], sums["tables"][b.context[seen]] - drawn, rng)
        customers = np.bincount(word, drawn, len(b.words)).astype(np.int64)
        return drawn, roots.draw(customers, np.full(len(b.words), 1 / (self.vocabulary + 1)), sums["root"] - root, rng)

    def seatings(self, bucket: int, b: Bucket) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Tables by pair, and customers and tables of the parent by word, after each sweep."""
        seen = np.flatnonzero(b.count > 0)
        drawn, root = self.first(b)
        for k in range(self.burn_in + self.samples):
            drawn, root = self.sweep(k, bucket, b, drawn, root)
            tables = np.zeros(len(b.count))
            tables[seen] = drawn
            yield tables, np.bincount(b.word[seen], drawn, len(b.words)), root

    def parent(self, sample: dict, words: np.ndarray, customers: np.ndarray, root: np.ndarray) -> np.ndarray:
        """The parent's probability of each word, given the sums after a sweep and a bucket's own words after it."""
        customers, root = customers.copy(), root.copy()
        if sample["frequent"]:
            known = np.fromiter(sample["frequent"], np.uint64, len(sample["frequent"]))
            for i in np.flatnonzero(np.isin(words, known)).tolist():
                customers[i], root[i] = sample["frequent"][int(words[i])]
        return (customers - self.discounts[1] * root + self.new_root(sample)) / (ROOT_CONCENTRATION + sample["total"])


def _small(a: np.ndarray) -> np.ndarray:
    """Whole numbers in the least type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _seat(model, k: int):
    """A row of each bucket, with its tables after the k-th sweep (not of the last, which nothing reads); and sums over a
    task's buckets: tables by context; the parent's customers and tables."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        by_context, sums, frequent = np.zeros(CONTEXTS, np.int64), np.zeros(2, np.int64), {}
        for batch in batches:
            for i in range(batch.num_rows):
                number, state, seats = (batch.column(c)[i].as_py() for c in range(3))
                b = Bucket(*_unpack(state))
                drawn, root = m.sweep(k, number, b, *(m.first(b) if seats is None else (a.astype(float) for a in _unpack(seats))))
                seen = b.count > 0
                customers = np.bincount(b.word[seen], drawn, len(b.words))
                by_context += np.bincount(b.context[seen], drawn, CONTEXTS).astype(np.int64)
                often = [(j, h) for j, h in enumerate(b.words.tolist()) if h in m.frequent]
                sums += int(customers.sum()), int(root.sum() - root[[j for j, _ in often]].sum())
                for j, h in often:
                    frequent[h] = frequent.get(h, 0) + int(customers[j])
                if k + 1 < m.burn_in + m.samples:
                    values = [number], [state], [_pack(_small(drawn), _small(root))], [None], [None], [None], [None]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, _SEATED_TYPES, strict=True)], names=_SEATED_NAMES)
        total = _totals(sums, by_context[None], frequent)
        nulls = [pa.nulls(total.num_rows, t) for t in _SEATED_TYPES[:3]]
        yield pa.RecordBatch.from_arrays([*nulls, *total.columns], names=_SEATED_NAMES)

    return run


_SEATED_NAMES = ["bucket", "state", "seats", "kind", "key", "n", "value"]
_SEATED_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]


def _sweeps(spark: SparkSession, model: Model, buckets: DataFrame) -> None:
    """Adds the sums after each sweep to the model. What a sweep has written is removed after the next one."""
    with ExitStack() as blocks:
        before = None
        for k in range(model.burn_in + model.samples):
            now = blocks.enter_context(ExitStack())
            now.enter_context(temporary(spark))
            sent = spark.sparkContext.broadcast(model)
            rows = stored(buckets.mapInArrow(_seat(sent, k), f"bucket long, state binary, seats binary, {_TOTALS}"), "hpy-seats")
            model.sums.append(_swept(model, _added(rows.where("bucket is null").drop("bucket", "state", "seats")).collect()))
            buckets = rows.where("bucket is not null").select("bucket", "state", "seats")
            if before:
                before.close()
            before = now


def _swept(model: Model, rows: list) -> dict:
    """The sums after a sweep from those of its tasks; the parent's tables of frequent words are drawn here."""
    out = {"tables": np.zeros(CONTEXTS), "total": 0.0, "root": 0.0, "frequent": {}}
    rng, before = np.random.default_rng([model.seed, 0, len(model.sums)]), model.sums[-1]
    draw = _drawing(model.discounts[1], ROOT_CONCENTRATION).draw
    for r in sorted(rows, key=lambda r: (r["kind"], r["key"])):
        value = np.frombuffer(r["value"], "<i8")
        if r["kind"] == 0:
            out["total"], out["root"] = float(value[0]), float(value[1])
        elif r["kind"] == 1:
            out["tables"][r["key"] : r["key"] + _BLOCK] = value
        else:
            customers = float(value[0])
            others = before["root"] - before["frequent"].get(r["key"] + (1 << 63), (0.0, 0.0))[1]
            root = float(draw(np.array([int(customers)]), np.array([1 / (model.vocabulary + 1)]), np.array([others]), rng)[0])
            out["frequent"][r["key"] + (1 << 63)] = customers, root
            out["root"] += root
    return out


# -- 4: scores -----------------------------------------------------------------------------------


def _score(model):
    names = ["chunk", "score", "base", "known"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, chunks = model.value, {}
        d = m.discounts[0]
        for batch in batches:
            for i in range(batch.num_rows):
                b = Bucket(*_unpack(batch.column(1)[i].as_py()), *_unpack(batch.column(2)[i].as_py()))
                total = np.zeros(len(b.count))
                for k, (tables, customers, root) in enumerate(m.seatings(batch.column(0)[i].as_py(), b)):
                    if k < m.burn_in:
                        continue
                    sample = m.sums[k + 1]
                    parent = m.parent(sample, b.words, customers, root)
                    new = (CONCENTRATION + d * sample["tables"][b.context]) * parent[b.word]
                    total += (b.count - d * tables + new) / (CONCENTRATION + m.contexts[b.context])
                score = np.log10(total / m.samples)
                counts = np.array([m.frequent.get(h, c) for h, c in zip(b.words.tolist(), b.word_counts().tolist(), strict=True)], float)
                base, known = np.log10(counts + 0.5)[b.word], (counts > 0)[b.word]
                for chunk, n_texts, pair, text, n in b.parts():
                    if chunk not in chunks:
                        chunks[chunk] = np.zeros((3, n_texts))
                    for row, values in zip(chunks[chunk], (score, base, known), strict=True):
                        row += np.bincount(text, values[pair] * n, n_texts)
        for chunk, (score, base, known) in chunks.items():
            values = [chunk], [score.astype("<f8").tobytes()], [base.astype("<f8").tobytes()], [known.astype("<u4").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if i == 0 else pa.binary()) for i, v in enumerate(values)], names=names)

    return run


def _finish(n: int, vocabulary: int):
    def run(rows: pa.Table) -> pa.Table:
        docs = next(r for r in rows.select(["ids", "held", "sizes"]).to_pylist() if r["sizes"] is not None)
        size = np.array(docs["sizes"], np.int64)
        score, base, known = (sum((np.frombuffer(v, k).astype(float) for v in rows[c].to_pylist() if v is not None), np.zeros(len(size))) for c, k in (("score", "<f8"), ("base", "<f8"), ("known", "<u4")))
        base = base - size * np.log10(n + 0.5 * (vocabulary + 1))
        ids = next(x for x in rows["ids"] if x.is_valid).values
        return pa.table({"id": ids, "held_out": pa.array(docs["held"], pa.bool_()), "n_tokens": size, "n_known": known.astype(np.int64), "train_tokens": np.full(len(size), n), "base_score": base, "score": score})

    return run


def _discount(once: int, twice: int) -> float:
    return min(max(once / (once + 2 * twice), 0.05), 0.95) if once else 0.5


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for every row of docs.

    The model is trained on rows where held_out is not true, and scores all rows. Tokens: runs without white space,
    A-Z in lower case, then one end of text. base_score: log10 under add-one-half unigrams of the training tokens;
    score: log10 under the hierarchical Pitman-Yor model. A null text is an empty one: an end alone. Repeated rows
    are trained on and scored each; null ids are kept; without training rows every word has the uniform probability.
    An empty table gives an empty result. Reruns on the same rows agree, in whatever partitions they come.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    survey = stored(rows.select("text", "held").mapInArrow(_survey, _TOTALS), "hpy-survey")
    tokens, n, contexts = 0, 0, np.zeros(CONTEXTS)
    for r in _added(survey.where("kind < 2")).collect():  # of a fixed size
        value = np.frombuffer(r["value"], "<i8")
        if r["kind"] == 0:
            tokens, n = int(value[0]), int(value[1])
        else:
            contexts[r["key"] : r["key"] + _BLOCK] = value
    buckets = max(BUCKETS, tokens // BUCKET + 1)
    words = survey.where("kind = 2").groupBy("key").agg(F.sum("n").alias("n"))
    often = words.where(F.col("n") * 4 * buckets >= tokens).collect()  # 4 * buckets words at most
    salts = {r["key"] + (1 << 63): min(CONTEXTS, 4 * buckets * r["n"] // tokens + 1) for r in often}

    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    ids = [T.StructField("ids", T.ArrayType(kind)), T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.LongType()))]
    dealt = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("blob", T.BinaryType()), *ids])
    state = T.StructType(
        [
            *[T.StructField(c, T.LongType()) for c in ("bucket", "chunk")],
            *ids,
            T.StructField("state", T.BinaryType()),
            T.StructField("texts", T.BinaryType()),
            T.StructField("pairs", T.BinaryType()),
            T.StructField("sums", T.ArrayType(T.LongType())),
            T.StructField("frequent", T.BinaryType()),
        ]
    )
    pairs = rows.mapInArrow(_deal(buckets, salts, to_arrow_type(kind)), dealt)
    pairs = stored(pairs.groupBy("bucket").applyInArrow(_gather(frozenset(salts)), state), "hpy-buckets")

    by_context, frequent, types = np.zeros(CONTEXTS, np.int64), {}, {}
    total = pairs.where("bucket >= 0").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(7)]).first()
    sums = np.array([total[i] or 0 for i in range(7)])
    for r in pairs.where("bucket >= 0").select("pairs", "frequent").mapInArrow(_facts, _TOTALS).transform(_added).collect():
        value = np.frombuffer(r["value"], "<i8")
        if r["kind"] == 1:
            by_context[r["key"] : r["key"] + _BLOCK] = value
        elif r["kind"] == 2:
            frequent[r["key"] + (1 << 63)], types[r["key"] + (1 << 63)] = (int(v) for v in value)
    vocabulary = int(sums[0]) + sum(c > 0 for c in frequent.values())
    start = {"tables": by_context, "total": float(sums[6]), "root": float(vocabulary), "frequent": {h: (float(t), min(1.0, float(t))) for h, t in types.items()}}
    model = Model(n, vocabulary, contexts, (_discount(int(sums[1]), int(sums[2])), _discount(int(sums[3]), int(sums[4]))), frequent, start, seed, burn_in, samples)
    _sweeps(spark, model, pairs.where("bucket >= 0").select("bucket", "state", F.lit(None).cast("binary").alias("seats")))
    second = spark.sparkContext.broadcast(model)
    texts = pairs.where("bucket < 0").select("chunk", "ids", "held", "sizes")
    scored = pairs.where("bucket >= 0").select("bucket", "state", "texts").mapInArrow(_score(second), "chunk long, score binary, base binary, known binary")
    both = texts.unionByName(scored, allowMissingColumns=True)
    out = T.StructType([T.StructField("id", kind), T.StructField("held_out", T.BooleanType())])
    for c in ("n_tokens", "n_known", "train_tokens"):
        out = out.add(c, T.LongType())
    out = out.add("base_score", T.DoubleType()).add("score", T.DoubleType())
    return both.groupBy("chunk").applyInArrow(_finish(n, vocabulary), out)


def _facts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs by context and counts of frequent words, summed over a task's buckets."""
    by_context, frequent = np.zeros(CONTEXTS, np.int64), {}
    for b in batches:
        for pairs, often in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by_context += _unpack(pairs)[0]
            for h, c, t in zip(*(x.tolist() for x in _unpack(often)), strict=True):
                frequent[h] = frequent.get(h, np.zeros(2, np.int64)) + (c, t)
    yield _totals([0], by_context[None], frequent)


def hpy_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, crc_mod("doc_id", 5) == 1).withColumnRenamed("id", "doc_id")
