"""Substring dedup by recompression: words that a window of WINDOW words covers which starts earlier too are removed.

Recompression names the parts of a text in rounds. A round first names runs of one symbol, then splits symbols in left
and right ones (by a bit of the name) and names every pair of a left one followed by a right one. A name is a 64-bit
function of what it stands for and of the round, so all tasks give a part the same name without asking, and whether a
part becomes a symbol is settled by the part and one symbol on either side: a repeated passage has the same symbols
inside, wherever it stands. For every symbol the range of words is kept that settles it.

Spark rounds:
1. marks: pairs of the second round, with the symbols around them, are counted over all texts, each once a block of
   texts; and so are the names of whole texts, the last round's symbols folded. Marks that occur once tell that no
   window around them repeats; of texts with one name, all but the first are copies and drop out here.
2. windows that no such mark rules out are named as wholes by two independent 64-bit functions of their words, and met
   in the order of texts: the first of a name stays, the others are repeats. Both functions must agree, so passages of
   different words are confused with a chance of about n^2 / 2^128.
3. the words that repeats cover are cut out of their texts.

Texts move as compressed blocks of rows that lie together, each to the answers for its block. A common passage is one
row for each block that has it, and those rows are ranked by a sort, so no group of them is held in memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import numbered, partitions, stored, table, temporary, trim, trimmed

WINDOW = 20
#: Rows of a block; a text with more characters than OWN is a block of its own.
BLOCK, OWN = 128, 1 << 16
#: Symbols on either side of a pair that are part of a mark, and rounds before what is left of a text is folded.
AROUND, ROUNDS = 1, 4
#: Words of texts that are parsed together, and words whose hash a worker remembers.
PARSED, REMEMBERED = 1 << 19, 400_000
#: Bytes of blocks after which a worker gives back what it has used.
TRIMMED = 4 << 20
#: Bits of a word's number in a place; the text's number in its block is above them.
START = 40
#: Odd multipliers of names and of the two functions of a window.
_LEFT, _RIGHT, _RUN, _ONE, _TWO = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ONE
    x = (x ^ (x >> np.uint64(29))) * _TWO
    return x ^ (x >> np.uint64(32))


def _named(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    return _mixed(a * _LEFT + _mixed(b * _RIGHT + np.uint64(level)))


class _Words(dict):
    """Hash of each word, computed when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 13)
        return h


class Parse:
    """Texts side by side, each followed by an end that equals nothing else."""

    def __init__(self, texts: list[list[bytes]], hashes: _Words) -> None:
        self.n = np.array([len(t) for t in texts], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.n + 1)))[:-1].astype(np.int64)
        total = int(self.n.sum()) + len(texts)
        self.words = np.empty(total, np.uint64)
        for i, (at, found) in enumerate(zip(self.begin.tolist(), texts, strict=True)):
            self.words[at : at + len(found)] = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
            self.words[at + len(found)] = xxhash.xxh64_intdigest(b"end %d" % i, 29)  # no word holds a space
        self.text = np.repeat(np.arange(len(texts)), self.n + 1)
        self.ends = self.begin + self.n

    def rounds(self, many: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(symbols, first word, word after the last) of each round; a symbol is settled by the words from the one
        before `first` to the one at `after`, and so are all that it is made of."""
        symbols, first = self.words, np.arange(len(self.words), dtype=np.int64)
        end = np.zeros(len(self.words) + 1, bool)
        end[self.ends] = True
        for level in range(1, many + 1):
            head = np.concatenate(([True], symbols[1:] != symbols[:-1]))
            at = np.flatnonzero(head)
            length = np.diff(np.append(at, len(symbols)))
            base, first = symbols[at], first[at]
            bit = (_mixed(base + np.uint64(level)) >> np.uint64(63)).astype(bool)
            runs = np.where(length > 1, _named(base, length.astype(np.uint64) * _RUN, level), base)
            last = end[first]
            left = ~bit & ~last
            right = bit & ~last
            pair = np.zeros(len(at), bool)  # the first of a pair
            pair[:-1] = left[:-1] & right[1:]
            symbols = runs.copy()
            k = np.flatnonzero(pair)
            symbols[k] = _named(runs[k], runs[k + 1], level)
            stays = np.ones(len(at), bool)
            stays[k + 1] = False
            symbols, first = symbols[stays], first[stays]
            yield symbols, first, np.append(first[1:], len(self.words))

    def marks(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(name, from, to) of the marks that some window of one text holds: `from` to `to` are the words that settle it."""
        symbols, first, after = next(self.rounds(1))
        bit = (_mixed(symbols + np.uint64(2)) >> np.uint64(63)).astype(bool)
        k = np.flatnonzero(~bit[:-1] & bit[1:])
        k = k[(k >= AROUND) & (k + 1 + AROUND < len(symbols))]
        low, high = first[k - AROUND] - 1, after[k + 1 + AROUND] + 1
        inside = (low >= 0) & (high - low <= window)
        k, low, high = k[inside], low[inside], high[inside]
        inside = high <= self.ends[self.text[low]]
        k, low, high = k[inside], low[inside], high[inside]
        name = symbols[k - AROUND]
        for i in range(1 - AROUND, AROUND + 2):
            name = _named(name, symbols[k + i], 2)
        return name, low, high

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent names of every text: its symbols of the last round folded, and its words."""
        *_, (symbols, first, _) = self.rounds(ROUNDS)
        out = []
        for values, places, factor in ((symbols, first, _LEFT), (_mixed(self.words ^ _TWO), np.arange(len(self.words)), _RIGHT)):
            text = self.text[places]
            inside = places < self.ends[text]
            heads = np.searchsorted(text, np.arange(len(self.n)))
            within = np.arange(len(text)) - heads[text]
            power = np.multiply.accumulate(np.full(within.max(initial=0) + 1, factor, np.uint64))
            out.append(np.add.reduceat(np.where(inside, values, np.uint64(0)) * power[within], heads) + _mixed(self.n.astype(np.uint64)))
        return out[0], out[1]

    def windows(self, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent names of the windows that start at these places."""
        other = _mixed(self.words ^ _RUN)
        one, two = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
        for i in range(window):
            one = one * _LEFT + self.words[starts + i]
            two = two * _RIGHT + other[starts + i]
        return one, two

    def candidates(self, shared: np.ndarray, copies: np.ndarray, window: int) -> np.ndarray:
        """Starts of windows that hold no mark outside `shared` (sorted names), in texts that aren't copies."""
        name, low, high = self.marks(window)
        at = np.searchsorted(shared, name)
        once = shared[np.minimum(at, len(shared) - 1)] != name if len(shared) else np.ones(len(name), bool)
        cut = np.zeros(len(self.words) + window + 2, np.int32)
        np.add.at(cut, np.maximum(high[once] - window, 0), 1)
        np.add.at(cut, low[once] + 1, -1)
        open_ = np.cumsum(cut)[: len(self.words)] == 0
        open_ &= np.arange(len(self.words)) + window <= self.ends[self.text]
        return np.flatnonzero(open_ & ~copies[self.text])


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Rows with the words of their texts, PARSED words or one text at a time."""
    for batch in batches:
        at, held, n = 0, [], 0
        for i, text in enumerate(batch.column("text")):
            found = (text.as_py() or "").encode().split()
            if held and n + len(found) > PARSED:
                yield batch.slice(at, len(held)), held
                at, held, n = i, [], 0
            held.append(found)
            n += len(found)
        if held:
            yield batch.slice(at, len(held)), held


def _mark(window: int, id_type: pa.DataType):
    """(block, at, id, name, check, many): marks once a block and slice (at = -1), whole texts with both names."""
    names = ["block", "at", "id", "name", "check", "many"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words()
        for rows, texts in _slices(batches):
            parse = Parse(texts, hashes)
            block = rows.column("block").to_numpy()
            name, low, _ = parse.marks(window)
            of = block[parse.text[low]]
            order = np.lexsort((name, of))
            name, of = name[order], of[order]
            head = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (of[1:] != of[:-1])))) if len(name) else np.empty(0, int)
            many = np.diff(np.append(head, len(name))) > 1
            n = len(head)
            none = pa.nulls(n, id_type)
            yield pa.RecordBatch.from_arrays([pa.array(of[head]), pa.array(np.full(n, -1)), none, pa.array(name[head].view(np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(many)], names=names)
            long_ = np.flatnonzero(parse.n >= window)
            if len(long_):
                one, two = (v[long_].view(np.int64) for v in parse.names())
                at = pa.array(long_)
                yield pa.RecordBatch.from_arrays([rows.column("block").take(at), rows.column("at").take(at), rows.column("id").take(at), pa.array(one), pa.array(two), pa.array(np.zeros(len(at), bool))], names=names)

    return run


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block that come together as one row: numbers, ids, and texts compressed as a whole."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        block = batch.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], np.diff(block[order]) != 0))) if len(block) else []
        for head, stop in zip(heads, np.append(heads[1:], len(block)) if len(block) else [], strict=True):
            part = batch.take(pa.array(order[head:stop]))
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            sizes = pa.array([[len(t) for t in texts]], pa.list_(pa.int64()))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(c)) for c in ("at", "id")]
            yield pa.RecordBatch.from_arrays([part.column("block").slice(0, 1), *lists, sizes, pa.array([squeeze.compress(b"".join(texts))], pa.binary())], names=["block", "at", "id", "sizes", "packed"])


def _unpack(block: pa.Table) -> tuple[list, list, list[list[bytes]]]:
    """Places, ids and words of the texts of a block, in order of (id, place), null ids last."""
    at, ids, texts, loosen = [], [], [], zstandard.ZstdDecompressor()
    for row in block.to_pylist():
        at += row["at"]
        ids += row["id"]
        whole, begin = loosen.decompress(row["packed"]), 0
        for size in row["sizes"]:
            texts.append(whole[begin : begin + size].split())
            begin += size
    order = sorted(range(len(at)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i], at[i]))
    return [at[i] for i in order], [ids[i] for i in order], [texts[i] for i in order]


def _candidates(window: int, id_type: pa.DataType):
    """(block, id, one, two, places): every window of a block that may repeat, once, with all its places in order."""
    names = ["block", "id", "one", "two", "places"]
    hashes = _Words()

    def run(key: tuple, block: pa.Table, known: pa.Table) -> pa.Table:
        at, ids, texts = _unpack(block)
        copies = np.isin(np.array(at, np.int64), known.column("at").to_numpy())
        parse = Parse(texts, hashes)
        shared = np.unique(known.column("name").to_numpy().view(np.uint64)[known.column("at").to_numpy() < 0])
        starts = parse.candidates(shared, copies, window)
        one, two = parse.windows(starts, window)
        text = parse.text[starts]
        places = text << START | (starts - parse.begin[text])
        order = np.argsort(one, kind="stable")
        one, two, places, text = one[order], two[order], places[order], text[order]
        head = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))) if len(one) else np.empty(0, int)
        lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(one)), pa.int32()), pa.array(places))
        first = pa.array(ids, id_type).take(pa.array(text[head]))
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(head), pa.int64()), first, pa.array(one[head].view(np.int64)), pa.array(two[head].view(np.int64)), lists], names=names)

    return run


def _returned(run):
    """A block's function that gives memory back to the system each TRIMMED bytes of blocks: workers live on from task to task."""
    held = 0

    def outer(key: tuple, block: pa.Table, known: pa.Table) -> pa.Table:
        nonlocal held
        held += block.nbytes + known.nbytes
        try:
            return run(key, block, known)
        finally:
            if held > TRIMMED:
                held = 0
                trim()

    return outer


SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


def _cut(window: int, id_type: pa.DataType):
    def run(key: tuple, block: pa.Table, known: pa.Table) -> pa.Table:
        at, ids, texts = _unpack(block)
        copies = set(known.column("at").to_pylist())
        places = np.sort(known.column("places").combine_chunks().flatten().to_numpy())
        bounds = np.searchsorted(places, np.arange(len(at) + 1, dtype=np.int64) << START)
        spans, kept, removed = [], [], []
        for i, found in enumerate(texts):
            starts = places[bounds[i] : bounds[i + 1]] & ((1 << START) - 1)
            if at[i] in copies:
                starts = np.arange(len(found) - window + 1)
            if not len(starts):
                spans.append([])
                kept.append(b" ".join(found).decode())
                removed.append(0)
                continue
            new = np.concatenate(([True], np.diff(starts) > window))
            begin = starts[new].tolist()
            stop = (starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)] + window).tolist()
            spans.append([{"start": a, "stop": b} for a, b in zip(begin, stop, strict=True)])
            removed.append(sum(stop) - sum(begin))
            rest, last = [], 0
            for a, b in zip(begin, stop, strict=True):
                rest += found[last:a]
                last = b
            kept.append(b" ".join(rest + found[last:]).decode())
        n = pa.array([len(t) for t in texts], pa.int64())
        return pa.Table.from_arrays([pa.array(ids, id_type), n, pa.array(removed, pa.int64()), pa.array(spans, pa.list_(SPAN)), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "spans", "kept"])

    return run


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, spans, kept), a row for every row of docs.

    Words are parts between space and 0x09-0x0D. A word is removed if a window of `window` words covers it whose words
    also start earlier: in a text before it in order of id, or earlier in the same text. Null ids come last; rows with
    equal ids are texts of their own, in an order that is fixed for a table. Windows are judged on the texts as they
    are given. spans: array of struct<start, stop>, the removed words, from 0, stop exclusive. kept: the others, joined
    by spaces. A null text has no words. Other columns of docs are not read. An empty table gives an empty result.
    """
    if window < 1:
        raise ValueError("a window holds a word at least")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    id_type = to_arrow_type(kind)
    looked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = numbered(looked, "row", "place").select("place.file", "place.at", "row.id", "row.text")
    own = F.when(F.length("text") > OWN, F.col("at"))
    rows = rows.select(F.xxhash64("file", F.floor(F.col("at") / BLOCK), F.coalesce(own, F.lit(-1))).alias("block"), "at", "id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = partitions(spark, total)
    long_ = T.LongType()
    marked = T.StructType().add("block", long_).add("at", long_).add("id", kind).add("name", long_).add("check", long_).add("many", T.BooleanType())
    packed = T.StructType().add("block", long_).add("at", T.ArrayType(long_)).add("id", T.ArrayType(kind)).add("sizes", T.ArrayType(long_)).add("packed", T.BinaryType())
    blocks = rows.mapInArrow(trimmed(_pack), packed).repartition(parts, "block").groupBy("block")
    with temporary(spark) as kept:
        marks = rows.mapInArrow(trimmed(_mark(window, id_type)), marked).repartition(parts, "name", "check")
        ranked = Window.partitionBy("name", "check").orderBy(F.col("id").isNull(), "id", "block", "at")
        marks = marks.withColumn("rank", F.row_number().over(ranked)).withColumn("more", F.lead(F.lit(1)).over(ranked))
        again = F.col("rank") > 1
        known = marks.where(F.when(F.col("at") < 0, again | F.col("more").isNotNull() | F.col("many")).otherwise(again))
        known = stored(known.select("block", "at", "name"), "repeat-marks")
        found = T.StructType().add("block", long_).add("id", kind).add("one", long_).add("two", long_).add("places", T.ArrayType(long_))
        windows = blocks.cogroup(known.repartition(parts, "block").groupBy("block")).applyInArrow(_returned(_candidates(window, id_type)), found)
        in_order = Window.partitionBy("one", "two").orderBy(F.col("id").isNull(), "id", "block", F.col("places")[0])
        windows = windows.repartition(parts, "one", "two").withColumn("first", F.row_number().over(in_order) == 1)
        repeats = windows.select("block", F.lit(-1).cast("long").alias("at"), F.when(F.col("first"), F.slice("places", 2, F.size("places"))).otherwise(F.col("places")).alias("places"))
        copies = known.where("at >= 0").select("block", "at", F.array().cast("array<long>").alias("places"))
        answers = kept(repeats.where(F.size("places") > 0).unionByName(copies), "repeat-windows")
    span = T.ArrayType(T.StructType().add("start", long_).add("stop", long_))
    out = T.StructType().add("id", kind).add("n_words", long_).add("n_removed", long_).add("spans", span).add("kept", T.StringType())
    return blocks.cogroup(answers.repartition(parts, "block").groupBy("block")).applyInArrow(_returned(_cut(window, id_type)), out)


def repeats_query(spark, sf_dir: str) -> DataFrame:
    found = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


REPEATS_SQL = r"""
with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
p as (select doc_id, i, ws[i:i + 19] as part from w, lateral unnest(range(1, len(ws) - 18)) u(i)),
r as (select doc_id, i, row_number() over (partition by part order by doc_id, i) as k from p),
c as (select distinct doc_id, unnest(range(i, i + 20)) as j from r where k > 1),
t as (select doc_id, j, ws[j] as word from w, lateral unnest(range(1, len(ws) + 1)) u(j)),
k as (select t.doc_id, count(c.j) as n_removed, string_agg(word, ' ' order by t.j) filter (where c.j is null) as kept
      from t left join c on c.doc_id = t.doc_id and c.j = t.j group by t.doc_id)
select w.doc_id, len(ws)::BIGINT as n_words, coalesce(n_removed, 0)::BIGINT as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k on k.doc_id = w.doc_id
"""
