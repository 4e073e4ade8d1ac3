"""MinHash signatures and the banded LSH index.

Equal signatures are one class: bands, candidates and similarities are computed between classes, so a group of copies
costs what one of them does; its members come back, in order of id and no more than a result can hold, at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import HASHES
from ..functions.similarity import equal_share
from ..session import stored
from ..sources.sinks import append_index, load_index, save_index
from .jaccard import tiled_join, tiled_pairs

#: Modulus of the native family: products of two residues fit a long.
PRIME = (1 << 31) - 1
#: Multiplier and offset of permutation i are these to the power i, modulo PRIME.
BASES = 48271, 69621
#: Hashes of a whole string; one of 32 bits is the same for two of 50,000 strings.
WHOLE = 8
#: Hashes that are permuted together, of one long item or of many.
SIGNED = 512
#: Classes that a task holds; pairs that it looks at together, and compares at a time; pairs of queries and classes from
#: which on they meet in tiles.
HELD, MET, SCORED, MANY = 1 << 18, 1 << 20, 1 << 14, 1 << 26
_MERSENNE, _MAX = (1 << 61) - 1, (1 << 32) - 1


def permutations(n: int) -> list[tuple[int, int]]:
    return [(pow(BASES[0], i, PRIME), pow(BASES[1], i, PRIME)) for i in range(1, n + 1)]


def best_bands(threshold: float, num_perm: int, steps: int = 1000) -> tuple[int, int]:
    """Bands and rows that make the least error: half the area of false positives below the threshold plus half that of
    false negatives above it, when a pair of similarity s is found with probability 1 - (1 - s^rows)^bands."""
    s = (np.arange(steps) + 0.5) / steps
    below, above = s[s < threshold], s[s >= threshold]
    best = min(
        ((1 - (1 - below**r) ** b).sum() + ((1 - above**r) ** b).sum(), b, r) for b in range(1, num_perm + 1) for r in range(1, num_perm // b + 1)
    )
    return best[1], best[2]


def native_signature(hashes: Column, num_perm: int) -> Column:
    """Least (a * h + b) mod PRIME over the hashes, for each permutation; null where there are none."""

    @F.arrow_udf("array<long>")
    def run(rows: pa.Array) -> pa.Array:
        some, found = _least(rows, num_perm)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some * num_perm))), pa.int32()), pa.array(found.ravel().astype(np.int64)))
        return pc.if_else(pa.array(some), lists, pa.nulls(len(rows), lists.type))

    return run(hashes)


def _least(rows: pa.Array, num_perm: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have hashes, and the signatures of these."""
    pairs = np.array(permutations(num_perm), np.int64)
    sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy()
    values = rows.flatten().to_numpy().astype(np.int64) % PRIME
    bounds = np.concatenate(([0], np.cumsum(sizes[sizes > 0])))
    found = np.full((len(bounds) - 1, num_perm), PRIME, np.uint32)
    for at in range(0, len(values), SIGNED):
        v = values[at : at + SIGNED, None] * pairs[:, 0]
        v += pairs[:, 1]
        v = (v & PRIME).astype(np.uint32) + (v >> 31).astype(np.uint32)  # 2^31 is 1 modulo PRIME
        v = np.minimum(v, v - np.uint32(PRIME))  # which wraps where v is smaller
        first, last = np.searchsorted(bounds, at, "right") - 1, np.searchsorted(bounds, at + len(v))
        v = np.minimum.reduceat(v, np.maximum(bounds[first:last] - at, 0))
        found[first:last] = np.minimum(found[first:last], v)
    return sizes > 0, found


def _keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A number for each band of signatures, band by band."""
    keys = np.zeros((bands, len(sig)), np.uint64)
    for r in range(rows):
        keys ^= sig[:, r : bands * rows : rows].T
        keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return keys


def _tile(num_perm: int, bands: int, rows: int, limit: int | None):
    """(kind, class, similarity) of rows (flag, kind, class, of): classes in order, then kinds that meet them, of each the
    `limit` best, or all classes above it. Pairs that have a band in common are found by its number, and checked."""

    def scored(left: np.ndarray, right: np.ndarray, q: np.ndarray, c: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Equal slots of pairs, -1 where no band is equal."""
        out = np.empty(len(q), np.int64)
        for i in range(0, len(q), SCORED):
            part = slice(i, i + SCORED)
            same = left[q[part]] == right[c[part]]
            packed = np.packbits(same, axis=1)
            out[part] = np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
            own = np.take_along_axis(same, band[part, None] * rows + np.arange(rows), axis=1).all(axis=1)
            for k in np.flatnonzero(~own):  # two bands of one number; another one may be equal
                if not same[k, : bands * rows].reshape(bands, rows).all(axis=1).any():
                    out[i + k] = -1
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sigs, order, keys = [], [], None, None
        for b in batches:
            split = int(np.searchsorted(b.column("flag").to_numpy(), 1))
            if split:
                names.append(b.column("class").slice(0, split))
                sigs.append(_least(b.column("of").slice(0, split), num_perm)[1])
            if split == b.num_rows or not sigs:
                continue
            if order is None:
                names, right = pa.concat_arrays(names), np.concatenate(sigs)
                sigs = [None]
                keys = _keys(right, bands, rows)
                order = np.argsort(keys, axis=1).astype(np.int32)
                keys = np.take_along_axis(keys, order, axis=1)
            kinds = b.column("kind").slice(split).to_numpy()
            left = _least(b.column("of").slice(split), num_perm)[1]
            asked = _keys(left, bands, rows)
            low = np.array([np.searchsorted(k, a) for k, a in zip(keys, asked, strict=True)])
            many = np.array([np.searchsorted(k, a, "right") for k, a in zip(keys, asked, strict=True)]) - low
            ends = np.concatenate(([0], np.cumsum(many.sum(axis=0))))
            lo = 0
            while lo < len(kinds):
                hi = min(max(lo + 1, int(np.searchsorted(ends, ends[lo] + MET, "right")) - 1), len(kinds))
                counts = many[:, lo:hi].ravel()
                at = np.repeat(low[:, lo:hi].ravel(), counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                band = np.repeat(np.repeat(np.arange(bands), hi - lo), counts)
                q = np.repeat(np.tile(np.arange(lo, hi), bands), counts)
                pairs, first = np.unique(q * len(right) + order[band, at], return_index=True)
                q, c, band = pairs // len(right), pairs % len(right), band[first]
                if limit is None:
                    up = kinds[q] < names.to_numpy()[c]
                    q, c, band = q[up], c[up], band[up]
                equal = scored(left, right, q, c, band)
                if limit is None:
                    some = np.flatnonzero(equal >= 0)
                else:  # classes are in order, so ties stay as they are
                    some = np.lexsort((-equal, q))
                    starts = np.flatnonzero(np.diff(q[some], prepend=-1))
                    place = np.arange(len(some)) - np.repeat(starts, np.diff(np.append(starts, len(some))))
                    some = some[(place < limit) & (equal[some] >= 0)]
                for i in range(0, len(some), SCORED):
                    part = some[i : i + SCORED]
                    yield pa.RecordBatch.from_arrays([pa.array(kinds[q[part]]), names.take(pa.array(c[part])), pa.array(equal[part] / num_perm)], names=["kind", "class", "similarity"])
                lo = hi

    return run


def whole_signature(hashes: Column, num_perm: int) -> Column:
    """As native_signature, with each permutation over one of the hashes in turn: signatures are equal if all hashes are."""
    perms = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(i % WHOLE).alias("k")) for i, (a, b) in enumerate(permutations(num_perm))])
    return F.transform(perms, lambda p: (p["a"] * (F.get(hashes, p["k"]) % PRIME) + p["b"]) % PRIME)


def compat_permutations(n: int, seed: int = 1) -> list[tuple[int, int]]:
    draw = np.random.RandomState(seed)
    return [(int(draw.randint(1, _MERSENNE, dtype=np.uint64)), int(draw.randint(0, _MERSENNE, dtype=np.uint64))) for _ in range(n)]


def compat_signature(hashes: Column, num_perm: int, seed: int = 1) -> Column:
    """The common library family: 64-bit products that wrap, modulo 2^61-1, low 32 bits, permutations from a Mersenne twister."""

    @F.pandas_udf("array<long>")
    def run(rows: pd.Series) -> pd.Series:
        pairs = np.array(compat_permutations(num_perm, seed), np.uint64).T
        low = lambda h: np.bitwise_and((np.asarray(h, np.uint64)[:, None] * pairs[0] + pairs[1]) % np.uint64(_MERSENNE), np.uint64(_MAX)).min(axis=0, initial=_MAX)
        return rows.map(lambda h: low(h).astype(np.int64))

    return run(hashes)


@dataclass(frozen=True)
class MinHash:
    """How signatures are made: of the set of tokens, or of the whole string as one element."""

    num_perm: int = 128
    threshold: float = 0.5
    hash_name: str = "sha1"
    shingle: str = "token"
    compat: bool = False

    @property
    def bands(self) -> tuple[int, int]:
        return best_bands(self.threshold, self.num_perm)

    def hashed(self, items: DataFrame) -> DataFrame:
        """(id, hashes) of items (id, tokens); items without tokens are left out."""
        items = items.where(F.size("tokens") > 0)
        if self.shingle == "whole":
            text, pieces = F.array_join("tokens", " "), range(1 if self.compat else WHOLE)
            items = items.select("id", F.array(*[F.concat(F.lit(f"{i}:" if i else ""), text) for i in pieces]).alias("tokens"))
        hash_of, words = HASHES[self.hash_name], F.array_distinct("tokens")
        hashes = hash_of.over_arrays(words) if hasattr(hash_of, "over_arrays") else F.transform(words, hash_of)
        return items.select("id", hashes.alias("hashes"))

    def signatures(self, items: DataFrame) -> DataFrame:
        """(id, sig)."""
        return stored(self.hashed(items), "hashes").select("id", self.signature(F.col("hashes")).alias("sig"))

    def signature(self, hashes: Column) -> Column:
        make = compat_signature if self.compat else whole_signature if self.shingle == "whole" else native_signature
        return make(hashes, self.num_perm)

    def band_keys(self, signatures: DataFrame) -> DataFrame:
        """(id, band, key) of signatures; a key is a slice of the signature."""
        b, r = self.bands
        keys = F.array(*[F.slice("sig", i * r + 1, r) for i in range(b)])
        return signatures.select("id", F.posexplode(keys).alias("band", "key"))

    def band_hashes(self, signatures: DataFrame) -> DataFrame:
        """(id, band, key) of signatures, a key being a hash of the slice; see share_a_band."""
        return self.band_keys(signatures).select("id", "band", F.xxhash64("key").alias("key"))

    def share_a_band(self, a: Column, b: Column) -> Column:
        """Two signatures have a slice in common, as their hashes said."""
        bands, r = self.bands
        return F.exists(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.slice(a, i * r + 1, F.lit(r)) == F.slice(b, i * r + 1, F.lit(r)))

    def signatures_of_rows(self, rows: DataFrame) -> DataFrame:
        """(id, sig) of rows (id, token): the tokens of an item may come in any number of rows, in any order, repeated.

        Each slot is a minimum, so map tasks combine what they have of an item, and parts of a signature can be merged
        later. Null tokens are passed over.
        """
        if self.compat or self.shingle != "token":
            raise ValueError("rows of tokens have native signatures of tokens")
        hashed = rows.where("token is not null").select("id", (HASHES[self.hash_name](F.col("token")) % PRIME).alias("h"))
        slots = [F.min((F.lit(a).cast("long") * F.col("h") + b) % PRIME).alias(f"m{i}") for i, (a, b) in enumerate(permutations(self.num_perm))]
        return hashed.groupBy("id").agg(*slots).select("id", F.array(*[F.col(f"m{i}") for i in range(self.num_perm)]).alias("sig"))

    def merged(self, signatures: DataFrame) -> DataFrame:
        """(id, sig) of signatures (id, sig) of parts of items: the least of each slot."""
        slots = [F.min(F.col("sig")[i]).alias(f"m{i}") for i in range(self.num_perm)]
        return signatures.groupBy("id").agg(*slots).select("id", F.array(*[F.col(f"m{i}") for i in range(self.num_perm)]).alias("sig"))


def _marked(rows: DataFrame, sig: Column) -> DataFrame:
    """rows with two hashes of their signatures, by which equal ones are found: two of n differ and have the same ones with a
    chance of n^2 / 2^129."""
    rows = rows.withColumn("_sig", sig)
    return rows.withColumn("h", F.xxhash64("_sig")).withColumn("g", F.xxhash64(F.lit(1), "_sig")).drop("_sig")


class MinHashIndex:
    """tables: members (id, class), classes (class, hashes, h, g), bands (class, band, key).

    A class is named by the smallest id it had when it came up; `grown` says that later ones may be smaller. What is kept
    of a class are the hashes of a title, some of them and of four bytes each, and not its signature, which is made of them
    where it is needed. Where only signatures are known (`signed`), classes are (class, sig, h).
    """

    def __init__(self, method: MinHash, members: DataFrame, classes: DataFrame, bands: DataFrame, grown: bool = False, signed: bool = False) -> None:
        self.method, self.members, self.classes, self.bands, self.grown, self.signed = method, members, classes, bands, grown, signed

    @classmethod
    def build(cls, items: DataFrame, method: MinHash | None = None) -> MinHashIndex:
        """items: (id, tokens), each id once."""
        method = method or MinHash()
        return cls._of(cls._hashed(method, items), method, False)

    @classmethod
    def of_signatures(cls, signatures: DataFrame, method: MinHash) -> MinHashIndex:
        return cls._of(stored(_marked(signatures.select("id", F.col("sig").alias("of")), F.col("of")), "signatures"), method, True)

    @classmethod
    def _of(cls, rows: DataFrame, method: MinHash, signed: bool) -> MinHashIndex:
        classes = stored(cls._table(cls._named(rows), signed), "classes")
        index = cls(method, None, classes, None, signed=signed)
        members = rows.select("id", "h", "g").join(index._classes().select("class", "h", "g"), ["h", "g"]).select("id", "class")
        index.members, index.bands = stored(members, "members"), stored(index._bands(index._classes()), "bands")
        return index

    @staticmethod
    def _hashed(method: MinHash, items: DataFrame) -> DataFrame:
        """(id, of, h, g) of items (id, tokens), stored; hashes of the native family fit 31 bits."""
        of = F.col("hashes") if method.compat else F.transform("hashes", lambda h: (h % PRIME).cast("int"))
        hashes = stored(method.hashed(items).select("id", of.alias("of")), "hashes")
        return stored(_marked(hashes, method.signature(F.col("of"))), "marked")

    def _rows(self, items: DataFrame) -> DataFrame:
        """(id, of, h, g) of items (id, tokens), as this index keeps them."""
        if not self.signed:
            return self._hashed(self.method, items)
        return stored(_marked(self.method.signatures(items).select("id", F.col("sig").alias("of")), F.col("of")), "signatures")

    @staticmethod
    def _named(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h", "g").agg(F.min("id").alias("class"), F.min_by("of", "id").alias("of")).select("class", "of", "h", "g")

    @staticmethod
    def _table(named: DataFrame, signed: bool) -> DataFrame:
        return named.select("class", F.col("of").alias("sig"), "h") if signed else named.select("class", F.col("of").alias("hashes"), "h", "g")

    def _classes(self) -> DataFrame:
        """(class, of, h, g)."""
        if not self.signed:
            return self.classes.withColumnRenamed("hashes", "of")
        return _marked(self.classes.select("class", F.col("sig").alias("of")), F.col("of"))

    def _signature(self, of: Column) -> Column:
        return of if self.signed else self.method.signature(of)

    def _bands(self, named: DataFrame, name: str = "class") -> DataFrame:
        """(name, band, key)."""
        return self.method.band_hashes(named.select(F.col(name).alias("id"), self._signature(F.col("of")).alias("sig"))).withColumnRenamed("id", name)

    def _scored(self, pairs: DataFrame) -> DataFrame:
        """pairs (.., x, y) of what is kept of two classes, with their similarity, where they have a band in common."""
        pairs = pairs.withColumns({"x": self._signature(F.col("x")), "y": self._signature(F.col("y"))})
        pairs = pairs.where(self.method.share_a_band(F.col("x"), F.col("y")))
        return pairs.withColumn("similarity", equal_share(F.col("x"), F.col("y"))).drop("x", "y")

    def _in_tiles(self, kinds: DataFrame, limit: int | None) -> DataFrame | None:
        """(kind, class, similarity) of kinds (kind, of) and their `limit` best classes in each tile, or all classes above
        them; None where look-ups of bands do better. No pair is dealt: a task holds a block of classes, and a share of the
        kinds streams past it, so what is moved grows with both and the number of blocks."""
        if self.signed or self.grown or self.method.compat or self.method.shingle != "token":
            return None
        classes, asked = self.classes.count(), kinds.count()
        if classes * asked < MANY:
            return None
        wide = math.ceil(classes / HELD)
        tall = max(1, math.ceil(2 * kinds.sparkSession.sparkContext.defaultParallelism / wide))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        kind = self.classes.schema["class"].dataType.simpleString()
        right = self.classes.select(F.pmod(F.xxhash64("class"), F.lit(wide)).alias("w"), each(tall).alias("t"), F.lit(0).alias("flag"), F.lit(None).cast("long").alias("kind"), "class", F.col("hashes").alias("of"))
        left = kinds.select(each(wide).alias("w"), F.pmod(F.xxhash64("kind"), F.lit(tall)).alias("t"), F.lit(1).alias("flag"), "kind", F.lit(None).cast(kind).alias("class"), "of")
        dealt = right.unionByName(left).withColumn("tile", (F.col("w") * tall + F.col("t")).cast("int")).repartitionById(wide * tall, "tile")
        dealt = dealt.sortWithinPartitions("flag", "class").select("flag", "kind", "class", "of")
        return dealt.mapInArrow(_tile(self.method.num_perm, *self.method.bands, limit), f"kind long, class {kind}, similarity double")

    def _added(self, items: DataFrame) -> dict[str, DataFrame]:
        """Rows of all tables for new items: known classes take them in, others come up."""
        rows = self._rows(items)
        own = stored(self._named(rows), "classes")
        known = self._classes().select(F.col("class").alias("_class"), "h", "g")
        known = stored(own.join(known, ["h", "g"]).select(F.col("_class").alias("class"), "h", "g"), "classes-known")
        fresh = stored(own.join(known.select("h", "g"), ["h", "g"], "left_anti").select("class", "of", "h", "g"), "classes-new")
        members = rows.select("id", "h", "g").join(known.unionByName(fresh.select("class", "h", "g")), ["h", "g"]).select("id", "class")
        return {"members": stored(members, "members"), "classes": stored(self._table(fresh, self.signed), "classes-new"), "bands": stored(self._bands(fresh), "bands")}

    def insert(self, items: DataFrame) -> MinHashIndex:
        """An index that holds items (id, tokens) too; only what they add is written."""
        new = self._added(items)
        return MinHashIndex(self.method, *[getattr(self, n).unionByName(new[n]) for n in ("members", "classes", "bands")], grown=True, signed=self.signed)

    def size(self) -> DataFrame:
        return self.members.agg(F.count(F.lit(1)).alias("index_size"))

    def candidates(self) -> DataFrame:
        """Pairs of classes (a < b), named by their smallest ids, with a band in common, and their estimated similarity."""
        if isinstance(self.classes.schema["class"].dataType, (T.LongType, T.IntegerType)):
            kinds = self._classes().select(F.col("class").cast("long").alias("kind"), "of")
            pairs = self._in_tiles(kinds, None)
            if pairs is not None:
                return pairs.select(F.col("kind").cast(self.classes.schema["class"].dataType).alias("a"), F.col("class").alias("b"), "similarity")
        of = self._classes().select("class", self._narrow().alias("of"))
        pairs = tiled_pairs(self.bands, ["band", "key"], "class").join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b")
        pairs = self._scored(pairs).select("a", "b", "similarity")
        if not self.grown:
            return pairs
        names = self.members.groupBy("class").agg(F.min("id").alias("name"))
        named = pairs.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b")
        return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")

    def search(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """(query, id, similarity, place) of the `limit` best items for each of queries (id, tokens), by similarity, then id."""
        asked, ranked = self.searched(queries, limit)
        return asked.join(ranked, "kind").select("query", "id", "similarity", "place")

    def searched(self, queries: DataFrame, limit: int = 10) -> tuple[DataFrame, DataFrame]:
        """(query, kind) of queries (id, tokens), and what `search` finds for each kind: (kind, id, similarity, place)."""
        rows = self._rows(queries)
        kinds = self._named(rows).select(F.monotonically_increasing_id().alias("kind"), "of", "h", "g")
        kinds = stored(kinds, "query-classes")  # queries of one signature find the same
        asked = rows.select(F.col("id").alias("query"), "h", "g").join(kinds.select("kind", "h", "g"), ["h", "g"]).select("query", "kind")
        whole = self.method.shingle == "whole" and not self.method.compat  # a band holds five hashes of the string
        scored = None if whole else self._in_tiles(kinds.select("kind", "of"), limit)
        if whole:
            scored = kinds.select("kind", "h", "g").join(self._classes().select("class", "h", "g"), ["h", "g"]).select("kind", "class", F.lit(1.0).alias("similarity"))
        elif scored is None:
            found = tiled_join(self._bands(kinds, "kind"), self.bands, ["band", "key"], "class").select("kind", "class")
            found = found.repartition("class").distinct()  # dealt once, for the pairs and for what is kept of their classes
            found = found.join(self._classes().select("class", self._narrow().alias("y")), "class").join(kinds.select("kind", self._narrow().alias("x")), "kind")
            scored = self._scored(found).select("kind", "class", "similarity")
        if not self.grown:  # a class has its smallest id as its name, so `limit` better classes leave it no place
            best = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("similarity"), "class"))
            scored = scored.withColumn("k", best).where(F.col("k") <= limit).drop("k")
        first = self.members.withColumn("k", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("k") <= limit)
        by_rank = Window.partitionBy("kind").orderBy(F.desc("similarity"), "id")
        ranked = scored.join(first.select("class", "id"), "class").withColumn("place", F.row_number().over(by_rank)).where(F.col("place") <= limit)
        return asked, ranked.select("kind", "id", "similarity", "place")

    def _narrow(self) -> Column:
        """What is kept of classes, as pairs carry it: slots of the native family fit 32 bits."""
        return F.col("of") if self.method.compat else F.col("of").cast("array<int>")

    def save(self, path: str) -> None:
        m = self.method
        settings = {"num_perm": m.num_perm, "threshold": m.threshold, "hash_name": m.hash_name, "shingle": m.shingle, "compat": m.compat}
        save_index({"members": self.members, "classes": self.classes, "bands": self.bands}, {"method": settings, "grown": self.grown, "signed": self.signed}, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> MinHashIndex:
        tables, settings = load_index(spark, path, "members", "classes", "bands", version=version)
        return cls(MinHash(**settings["method"]), **tables, grown=settings["grown"], signed=settings.get("signed", True))

    @classmethod
    def append(cls, items: DataFrame, path: str) -> MinHashIndex:
        """Insert items (id, tokens) into a saved index: what they add is written, and a version published that lists it."""
        spark = items.sparkSession
        _, settings = load_index(spark, path, "members")
        append_index(cls.load(spark, path)._added(items), path, settings | {"grown": True})
        return cls.load(spark, path)
