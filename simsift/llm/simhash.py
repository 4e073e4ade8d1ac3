"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints within `bits` of each other are found by cutting the 64 positions into parts and giving
part i a threshold t_i such that sum(t_i + 1) = bits + 1: two such fingerprints are within t_i on at
least one part. Correlated positions are put into the same part, and the thresholds - unequal, some
parts may go unused - come from a dynamic program over estimated candidate counts. The number of parts
is chosen by the same estimate, so keys get wider as the corpus grows and the work stays in proportion.

Plan: fingerprints are computed in the map tasks; equal ones become one node by a partial aggregate, so
a group of copies costs one row. Nodes probe by keys (their bits in a part, and neighbours of those); a
key's nodes are compared in one task, which returns a spanning forest of the links it verified and not
the pairs. A key with more than HOT nodes is dealt to several tasks by the same principle on positions
all over the fingerprint, and a bucket beyond BUCKET nodes is cut once more in memory.

Near-duplicates by Jaccard similarity (`drop_near`) use the same probes: two sets of similarity s differ
in a share acos(2s / (1 + s)) / pi of the positions, and `reach` chooses how many fingerprints are probed
within how many bits, so that a pair at the threshold is found with probability RECALL at the least
estimated cost. With more documents it takes more fingerprints and narrower keys; a fixed radius would
compare a fixed share of all pairs. Candidates are verified on their whole shingle sets, so no pair
below the threshold links.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, partitions, stored, table, temporary, trimmed
from .components import Forest, components

WORDS, BITS = 4, 4
#: Nodes of one key that are compared all with all; larger buckets are cut again.
BUCKET = 2048
#: Cost of a shuffled key against that of a compared pair.
KEY_COST = 20.0
#: Key rows a task reads.
KEYS_PER_TASK = 2_000_000
#: Nodes of a key from which on it is dealt to several tasks; keys are counted on one node in COUNTED.
HOT, COUNTED = 50_000, 8
#: Hot keys that are broadcast at most; more are joined like any table.
HOT_KEYS = 10_000
#: Nodes of a cell in which all pairs are compared by their sets, and of those that join every cell of a group.
CELL, PIVOTS = 128, 8
#: Words and Jaccard similarity of near-duplicates, and the share of pairs at just that similarity that probes should find.
NEAR_WORDS, SIMILARITY, RECALL = 5, 0.8, 0.95
#: Cost of a further fingerprint of a document against that of a compared pair.
FINGERPRINT_COST = 30_000.0
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of a text, repeats included, A-Z in lower case; of the whole of a shorter one."""
    tokens = (text or "").encode().lower().split()
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), 42)] if tokens else [], np.uint64)
    body = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(tokens) - words + 1].tolist()
    h, digest = np.empty(len(starts), np.uint64), xxhash.xxh64_intdigest
    h[:] = [digest(body[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    return h


def majority(h: np.ndarray) -> int:
    """Bit i is set if it is in over half of the hashes; 0 without any."""
    if len(h) < 2:
        return int(h[0]) if len(h) else 0
    counts = np.zeros(64, np.int64)
    for k in range(8):  # bit k of all eight bytes at once; a lane holds 255 at most
        bits = (h >> np.uint64(k)) & _LANES
        whole = len(bits) // 255 * 255
        sums = bits[:whole].reshape(-1, 255).sum(axis=1, dtype=np.uint64) if whole else np.empty(0, np.uint64)
        sums = np.append(sums, bits[whole:].sum(dtype=np.uint64))
        counts[k::8] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    return majority(shingle_hashes(text, words))


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Further hashes of the same shingles, by a finalizer of multiplications and shifts."""
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _fingerprints(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(text, words) for text in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return run


def names(further: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, further + 1))]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp) of every row: 64 bits as a long."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(_fingerprints(words)), schema)


def _together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((64, 64), np.int64), 0
    for b in batches:
        fp = b.column(0).to_numpy().astype(np.int64).view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
        total += (bits.T @ bits).astype(np.int64)
        n += len(bits)
    i, j = np.triu_indices(64)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()), pa.array(np.append(total[i, j], n), pa.int64())], names=["i", "j", "n"])


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, share of ones by position, and correlation of positions; over all fingerprints."""
    rows = nodes.select("fp").mapInArrow(_together, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    found = {(r["i"], r["j"]): r["n"] for r in rows}
    n, both = found.get((-1, -1), 0), np.zeros((64, 64))
    for (i, j), k in found.items():
        if i >= 0:
            both[i, j] = both[j, i] = k
    both /= max(n, 1)
    ones = both.diagonal().copy()
    spread = np.sqrt(np.maximum(ones * (1 - ones), 1e-12))
    return n, ones, np.abs((both - np.outer(ones, ones)) / np.outer(spread, spread))


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Positions in parts of equal width; each part grows by the position that is most correlated with it."""
    free, out = set(range(64)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        seed = max(sorted(free), key=lambda b: sum(correlation[b, x] for x in free if x != b))
        part = [seed]
        free.remove(seed)
        while len(part) < width:
            b = max(sorted(free), key=lambda b: sum(correlation[b, x] for x in part))
            part.append(b)
            free.remove(b)
        out.append(sorted(part))
    return out


def within(ones: np.ndarray, part: list[int]) -> np.ndarray:
    """Estimated probability that two fingerprints differ in 0, 1, 2 positions of the part at most."""
    p = np.zeros(4)
    p[0] = 1.0
    for b in part:
        q = 2 * ones[b] * (1 - ones[b])
        p[1:], p[0] = p[1:] * (1 - q) + p[:-1] * q, p[0] * (1 - q)
    return np.cumsum(p)[:3]


def allocate(n: int, ones: np.ndarray, correlation: np.ndarray | None, bits: int = BITS) -> tuple[list[tuple[list[int], int]], float]:
    """Parts with their thresholds, -1 for a part that goes unused, and the cost. Sum of threshold + 1 is bits + 1.

    For each number of parts, a dynamic program over the parts spends bits + 1 units, three on a part at
    most, at the least cost: keys to shuffle and pairs to compare, estimated from all fingerprints.
    Without correlations, positions are taken in turn.
    """
    best, plan = np.inf, []
    for m in range(2, bits + 2):
        if 3 * m < bits + 1:
            continue
        parts = [list(range(k, 64, m)) for k in range(m)] if correlation is None else group_bits(correlation, m)
        least = {0: (0.0, [])}
        for part in parts:
            p, w = within(ones, part), len(part)
            keys = (0, 1, 1 + w / 2, 1 + w)
            cost = [0.0, *[KEY_COST * n * keys[e] + n * n / 2 * p[e - 1] for e in (1, 2, 3)]]
            step: dict = {}
            for used, (c, chosen) in least.items():
                for e in range(min(3, bits + 1 - used) + 1):
                    if used + e not in step or c + cost[e] < step[used + e][0]:
                        step[used + e] = (c + cost[e], [*chosen, e - 1])
            least = step
        c, chosen = least[bits + 1]
        if c < best:
            best, plan = c, list(zip(parts, chosen, strict=True))
    return plan, best


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def keys(fp: Column, plan: list[tuple[list[int], int]]) -> Column:
    """Keys by which a fingerprint probes. Of two at distance one in a part, the one with an even number of ones
    takes the other's key; at distance two they meet in between. Positions outside the part are zero."""
    out = []
    for part, threshold in plan:
        if threshold < 0:
            continue
        own = fp.bitwiseAND(F.lit(_signed(sum(1 << b for b in part))))
        near = F.array(own, *[own.bitwiseXOR(F.lit(_signed(1 << b))) for b in part])
        if threshold == 0:
            out.append(F.array(own))
        elif threshold == 1:
            out.append(F.when(F.bit_count(own) % 2 == 0, near).otherwise(F.array(own)))
        else:
            out.append(near)
    return F.concat(*out)


def _hot(probes: DataFrame, bits: int) -> DataFrame:
    """probes (key, node, fp, ...) with the rows of hot keys under bits + 1 narrower keys each: the key and the bits at
    every (bits + 1)th position. Two within `bits` agree on one of these cuts, so none is lost."""
    some = probes.where(F.pmod(F.xxhash64("node"), F.lit(COUNTED)) == 0)
    hot = stored(some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * COUNTED > HOT).select(F.col("key").alias("hot")), "simhash-hot")
    n = hot.count()
    if not n:
        return probes
    both = probes.join(F.broadcast(hot) if n <= HOT_KEYS else hot, F.col("key") == F.col("hot"), "left")
    cuts = [F.xxhash64("key", F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in range(k, 64, bits + 1)))))) for k in range(bits + 1)]
    narrow = F.when(F.col("hot").isNull(), F.array("key")).otherwise(F.array(*cuts))
    others = [c for c in probes.columns if c != "key"]
    return both.select(F.explode(narrow).alias("key"), *others)


class _Nodes:
    """Distinct nodes of a task and their fingerprints."""

    def __init__(self, fp: np.ndarray, bits: int) -> None:
        self.fp, self.bits, self.forest = fp.view(np.uint64), bits, Forest(len(fp))

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fp[a] ^ self.fp[b]) <= self.bits

    def short(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join those of the pairs (a, b) that are near."""
        near = self.near(a, b) & (a != b)
        self.forest.join(a[near], b[near])

    def compare(self, at: np.ndarray, free: np.ndarray) -> None:
        """Join all of `at` that are near. A large bucket is cut again by the positions in free, where that leaves less to compare."""
        if len(at) > BUCKET and len(free) > self.bits:
            cuts, work = [], 0
            for cut in np.array_split(free, self.bits + 1):
                value = self.fp[at] & np.uint64(sum(1 << int(b) for b in cut))
                order = np.argsort(value, kind="stable")
                parts = np.split(at[order], np.flatnonzero(np.diff(value[order])) + 1)
                cuts.append((np.setdiff1d(free, cut), parts))
                work += sum(len(p) ** 2 for p in parts)
            if work < len(at) ** 2 / 2:
                for rest, parts in cuts:
                    for part in parts:
                        if len(part) > 1:
                            self.compare(part, rest)
                return
        self.every(at)

    def every(self, at: np.ndarray) -> None:
        rows = max(1, (1 << 20) // len(at))
        for i in range(0, len(at), rows):
            a, b = np.nonzero(self.near(at[i : i + rows, None], at[None, i:]))
            self.forest.join(at[i : i + rows][a], at[i:][b])


class _Candidates(_Nodes):
    """Nodes that are near if they are within `bits` in the first fingerprint and within `most` in all together."""

    def __init__(self, fp: np.ndarray, bits: int, further: list[np.ndarray], most: int) -> None:
        super().__init__(fp, bits)
        self.further, self.most = [f.view(np.uint64) for f in further], most

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = super().near(a, b)
        i = np.nonzero(found)
        a, b = (np.broadcast_to(x, found.shape)[i] for x in (a, b))
        total = np.bitwise_count(self.fp[a] ^ self.fp[b]).astype(np.int16) + sum(np.bitwise_count(f[a] ^ f[b]).astype(np.int16) for f in self.further)
        found[i] = total <= self.most
        return found


def _links(make):
    """Links of the nodes of each key; make: from the distinct nodes' columns after (key, node) to _Nodes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not got:
            return
        key, node, *values = (np.concatenate([g[i] for g in got]) for i in range(len(got[0])))
        del got
        order = np.argsort(key, kind="stable")
        key, (node, first, place) = key[order], np.unique(node[order], return_index=True, return_inverse=True)
        nodes = make([v[order][first] for v in values])
        bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        length = np.diff(bounds)
        small = np.repeat(length <= 64, length)  # runs of up to 64 are compared by distance in the run, all runs at once
        rest = np.repeat(bounds[1:], length) - np.arange(len(key))
        for d in range(1, int(min(length.max(), 64))):
            i = np.flatnonzero(small & (rest > d))
            for j in range(0, len(i), 1 << 20):
                nodes.short(place[i[j : j + (1 << 20)]], place[i[j : j + (1 << 20)] + d])
        for s, n in zip(bounds[:-1][length > 64].tolist(), length[length > 64].tolist(), strict=True):
            nodes.compare(np.unique(place[s : s + n]), np.arange(64))
        a, b = nodes.forest.links()
        for i in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[a[i : i + 100_000]]), pa.array(node[b[i : i + 100_000]])], names=["a", "b"])

    return run


def _probed(nodes: DataFrame, bits: int, own: str, others: list[str]) -> DataFrame:
    """(key, node, fp, others) of nodes by the keys of the fingerprint `own`, dealt by key; others are renamed, for one may be called fp."""
    n, ones, correlation = bit_statistics(nodes.select(F.col(own).alias("fp")))
    plan, _ = allocate(n, ones, correlation, bits)
    per_node = sum((0, 1, 1 + len(p) / 2, 1 + len(p))[t + 1] for p, t in plan)
    parts = max(partitions(nodes.sparkSession), int(n * per_node / KEYS_PER_TASK) + 1)
    probes = nodes.select(F.explode(keys(F.col(own), plan)).alias("key"), "node", F.col(own).alias("fp"), *(F.col(c).alias(f"other{i}") for i, c in enumerate(others)))
    return _hot(probes, bits).repartition(parts, "key")


def near_links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) that connect just those of nodes (node, fp) that a chain of near ones connects."""
    return _probed(nodes, bits, "fp", []).mapInArrow(trimmed(_links(lambda v: _Nodes(v[0], bits))), "a long, b long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """(id, fp, component_id) of every row: its fingerprint, and the smallest id that links reach.

    Two rows link when their fingerprints differ in `bits` positions at most. A null text counts as empty;
    texts without words have fingerprint zero and link like any other. Rows with equal ids each keep their
    fingerprint; a null id is never a component's name unless no row of the component has another.
    Repeated rows stay repeated. An empty table gives an empty result.
    """
    rows = stored(fingerprints(docs, id_col, text_col, words), "simhash")
    with temporary(docs.sparkSession) as kept:
        nodes = rows.groupBy("fp").agg(F.min("id").alias("least"))
        nodes = stored(nodes.withColumn("node", F.col("fp")), "simhash-nodes")
        labels = components(near_links(nodes, bits), "simhash-links").withColumnRenamed("node", "linked")
        named = nodes.join(labels, F.col("node") == F.col("linked"), "left").select("fp", "least", F.coalesce("label", "node").alias("label"))
        named = stored(named, "simhash-named")  # read back, as is the next: a join of plain exchanges can split a large component
        best = stored(named.groupBy("label").agg(F.min("least").alias("component_id")), "simhash-names")
        classes = kept(named.join(best, "label").select("fp", "component_id"), "simhash-classes")
    return rows.join(classes, "fp").select("id", "fp", "component_id")


# -- near-duplicates by Jaccard similarity ---------------------------------------------------------


def differing(similarity: float) -> float:
    """Share of positions in which the fingerprints of two sets of this Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _at_most(n: int, p: float, k: int) -> float:
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(k, n) + 1))


def reach(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """Fingerprints to probe by, and bits within which: the cheapest for n documents that find a pair of the similarity
    with the probability asked for."""
    p, even = differing(similarity), np.full(64, 0.5)
    best = (math.inf, 1, 4)
    for bits in range(4, 17):
        probes = max(1, math.ceil(math.log(1 - recall) / math.log(1 - _at_most(64, p, bits))))
        cost = probes * (allocate(n, even, None, bits)[1] + FINGERPRINT_COST * n)
        best = min(best, (cost, probes, bits))
    return best[1], best[2]


def bound(similarity: float, fingerprints_: int) -> int:
    """Bits in all fingerprints together within which 99 in 100 pairs of the similarity are."""
    p, k = differing(similarity), 0
    while _at_most(64 * fingerprints_, p, k) < 0.99:
        k += 1
    return k


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def _marks(words: int, n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.zeros((b.num_rows, 1 + n), np.uint64)
            for i, text in enumerate(b.column(1)):
                h = shingle_set(text.as_py(), words)
                found[i] = [xxhash.xxh64_intdigest(h.tobytes()), majority(h), *(majority(mixed(h, k)) for k in range(1, n))]
            columns = [pa.array(np.ascontiguousarray(c)) for c in found.view(np.int64).T]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["row", "node", *names(n - 1)])

    return run


def _sets(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), words).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def shared(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Of each set, its place and the number of elements it shares with every set."""
    number = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.empty(0, int)
    ends = np.cumsum([len(s) for s in sets])
    mark = np.zeros(len(number) + 1, np.int64)
    for k, (s, e) in enumerate(zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True)):
        mark[number[s:e]] = 1
        sums = np.concatenate(([0], np.cumsum(mark[number])))
        mark[number[s:e]] = 0
        yield k, sums[ends] - np.concatenate(([0], sums[ends[:-1]]))


def _tile(similarity: float):
    """Links of a forest of the nodes of a tile, by their whole sets; rows: node, shingles."""
    ratio = Fraction(str(similarity))

    def run(rows: pa.Table) -> pa.Table:
        node, first = np.unique(rows["node"].to_numpy(), return_index=True)
        values = rows["shingles"].combine_chunks()
        sets = [np.frombuffer(values[i].as_buffer(), np.uint64) for i in first.tolist()]
        size, forest = np.array([len(s) for s in sets], np.int64), Forest(len(sets))
        for k, common in shared(sets):
            near = np.flatnonzero(common * (ratio.numerator + ratio.denominator) >= ratio.numerator * (size[k] + size))
            forest.join(np.full(len(near), k), near)
        a, b = forest.links()
        return pa.table({"a": pa.array(node[a], pa.int64()), "b": pa.array(node[b], pa.int64())})

    return run


def _cell(n) -> Column:
    """Nodes of a cell of a group of n: CELL, or more where the group has over 32 * CELL."""
    return F.greatest(F.lit(CELL), F.least(F.lit(32 * CELL), F.floor(n / 32)))


def similar_labels(rows: DataFrame, words: int = NEAR_WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(row, label) of rows (row, text), row being distinct: equal labels for those that a chain of links connects.

    SimHash probes give a forest of candidates; what it connects is a group. In a group of up to CELL nodes all pairs
    are compared by their whole sets of shingles. The nodes of a larger group are dealt to cells first, each together
    with a few nodes that have many candidates; then cells are compared with each other, but for pairs of cells that
    hold only nodes of the label that most of the group has by then. So a large group of near copies costs no row for
    each two. A null text counts as empty; texts without words are equal sets.
    """
    spark = rows.sparkSession
    probes, bits = reach(rows.count(), similarity, recall)
    n = max(2, probes)  # a second fingerprint rules out most chance neighbours of the first
    most, own = bound(similarity, n), names(n - 1)
    kind = rows.schema["row"].dataType.simpleString()
    with temporary(spark) as kept:
        marks = stored(rows.mapInArrow(trimmed(_marks(words, n)), ", ".join([f"row {kind}", "node long", *(f"{c} long" for c in own)])), "near-marks")
        nodes = stored(marks.groupBy("node", *own).agg(F.min("row").alias("row")), "near-nodes")
        each = [_probed(nodes, bits, c, [x for x in own if x != c]).mapInArrow(trimmed(_links(lambda v: _Candidates(v[0], bits, v[1:], most))), "a long, b long") for c in own[:probes]]
        pairs = stored(reduce(DataFrame.union, each).distinct(), "near-pairs")
        groups = components(pairs, "near-groups").withColumnRenamed("label", "group")
        degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        members = stored(groups.join(degree, "node"), "near-members")
        sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
        texts = rows.join(members.join(nodes, "node").select("node", "row"), "row").select("node", "text")
        sets = stored(texts.mapInArrow(trimmed(_sets(words)), "node long, shingles binary"), "near-sets")

        turn = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(PIVOTS))
        pivots = members.groupBy("group", turn.alias("turn")).agg(F.max(F.struct("degree", "node"))["node"].alias("node"))
        cells = F.ceil(F.col("n") / _cell(F.col("n")))
        alone = members.join(sizes, "group").select("node", "group", F.pmod(F.xxhash64("node"), cells).alias("cell"))
        led = pivots.join(sizes.where(cells > 1), "group").select("node", "group", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1)).alias("cell"))
        tiles = alone.unionByName(led).select("node", F.xxhash64("group", "cell").alias("tile"))

        def compared(tiles: DataFrame) -> DataFrame:
            dealt = tiles.join(sets, "node").select("tile", "node", "shingles")
            return stored(dealt.groupBy("tile").applyInArrow(_tile(similarity), "a long, b long"), "near-links")

        links = compared(tiles)
        large = stored(sizes.where(cells > 1), "near-large")
        if large.count():
            labels = components(links, "near-labels").withColumnRenamed("node", "linked")
            named = members.join(large, "group").join(labels, F.col("node") == F.col("linked"), "left").select("node", "group", F.coalesce("label", "node").alias("label"))
            named = stored(named, "near-apart")
            counts = named.groupBy("group", "label").agg(F.count(F.lit(1)).alias("m"))
            facts = stored(counts.groupBy("group").agg(F.max(F.struct("m", "label")).alias("main"), F.sum("m").alias("n")), "near-mains")
            size, rest = _cell(F.col("n")), F.col("n") - F.col("main.m")
            facts = facts.select("group", F.col("main.label").alias("main"), F.ceil(rest / size).alias("others"), F.ceil(F.col("main.m") / size).alias("mains")).where("others > 0")
            named = named.join(facts, "group")
            # cells of the other labels are 0 to others - 1, those of the main one follow; a tile is a pair of cells, the first one of others
            other = F.pmod(F.xxhash64("node", F.lit(2)), "others")
            main = F.col("others") + F.pmod(F.xxhash64("node", F.lit(2)), "mains")
            with_ = lambda a, b: F.struct(F.least(a, b).alias("i"), F.greatest(a, b).alias("j"))
            zero = F.lit(0).cast("long")
            as_other = F.transform(F.sequence(zero, F.col("others") + F.col("mains") - 1), lambda c: with_(other, c))
            as_main = F.transform(F.sequence(zero, F.col("others") - 1), lambda c: with_(main, c))
            pairs_of = F.explode(F.when(F.col("label") == F.col("main"), as_main).otherwise(as_other)).alias("t")
            tiles = named.select("node", "group", pairs_of).select("node", F.xxhash64("group", "t.i", "t.j").alias("tile"))
            links = links.union(compared(tiles))
        labels = components(links, "near-labels").withColumnRenamed("node", "linked")
        return kept(marks.join(labels, F.col("node") == F.col("linked"), "left").select("row", F.coalesce("label", "node").alias("label")), "near-labelled")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = NEAR_WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id, nulls last; of equal ids, any one of them.

    Groups are those that chains of pairs connect whose sets of shingles have the Jaccard similarity or more. Every
    link is verified; a pair at just the similarity is found with about the probability `recall`, a closer one more
    likely. A null text counts as empty, and texts without words are one group. Repeated rows are near-duplicates
    like others: rows go by their place, not by their id. All columns stay, whatever their names. An empty table
    gives an empty result.
    """
    packed = numbered(docs, "row", "place")
    with temporary(docs.sparkSession) as kept:
        labels = similar_labels(packed.select(F.col("place").alias("row"), F.col("row")[text_col].cast("string").alias("text")), words, similarity, recall)
        id_ = F.col("row")[id_col]
        named = packed.select("place", F.struct(id_.isNull().alias("none"), id_.alias("id"), "place").alias("name"))
        named = stored(named.join(labels.withColumnRenamed("row", "place"), "place"), "near-named")
        best = stored(named.groupBy("label").agg(F.min("name")["place"].alias("best")), "near-best")
        gone = kept(named.join(best, "label").where("place <> best").select("place"), "near-gone")
    return packed.join(gone, "place", "left_anti").select("row.*")


def simhash_query(spark, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
