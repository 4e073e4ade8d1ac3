"""Periodic runs of words by Crochemore's partition refinement.

Positions of a text are kept in classes of equal factors, first of length 1, then 2 and so on. A class of length l is
split by what follows: positions whose successors lie in a class that was split off. Of the parts of a split class the
largest is never used to split others (what it would move is what the others leave), so a position is touched a
logarithmic number of times. Members of a class are linked in order of place; neighbours at a distance equal to the
length are a square, and squares of one period that overlap by a period are merged into a run.

Only runs that repeat EXPONENT times are asked for: each has a class of that many members at every length up to its
period, so smaller classes are dead: they still split others once, but are not split or searched any more.

All texts of a batch are refined together as numpy arrays, a text's end being a word of its own. Texts are rows: Spark
deals them to tasks, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, table

#: A run repeats its period so many times and has so many words at least.
EXPONENT, LEAST = 4, 6
#: Words of texts that are refined together, unless one text alone has more.
BATCH = 1 << 20


class _Squares:
    """Places to look at once factors are as long as their gap; a gap that has changed since is dropped then."""

    def __init__(self) -> None:
        self.waiting: dict[int, list[np.ndarray]] = {}

    def add(self, places: np.ndarray, gaps: np.ndarray) -> None:
        order = np.argsort(gaps, kind="stable")
        places, gaps = places[order], gaps[order]
        cuts = np.flatnonzero(np.diff(gaps)) + 1
        for part, gap in zip(np.split(places, cuts), gaps[np.concatenate(([0], cuts))].tolist(), strict=True):
            self.waiting.setdefault(gap, []).append(part)

    def pop(self, gap: int) -> np.ndarray:
        found = self.waiting.pop(gap, None)
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a value in sorted keys differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


class Refinement:
    """Classes of equal factors over a sequence of words; `limit[i]` is the greatest period asked for at place i."""

    def __init__(self, words: np.ndarray, limit: np.ndarray, exponent: int = EXPONENT) -> None:
        n = len(words)
        self.least, self.limit, self.level = exponent, limit, 1
        self.order = np.argsort(words, kind="stable")  # places, class by class
        heads = _heads(words[self.order])
        self.start = np.zeros(n, np.int64)  # of a class in `order`
        self.size = np.zeros(n, np.int64)
        self.classes = len(heads)
        self.start[: len(heads)] = heads
        self.size[: len(heads)] = np.diff(np.append(heads, n))
        self.of = np.empty(n, np.int64)  # class of a place
        self.of[self.order] = np.repeat(np.arange(len(heads)), self.size[: len(heads)])
        self.at = np.empty(n, np.int64)  # where a place stands in `order`
        self.at[self.order] = np.arange(n)
        self.next = np.full(n, -1)
        self.prev = np.full(n, -1)
        self.squares = _Squares()
        self._link(self.order, self.of[self.order])
        self.small = np.arange(len(heads))

    def _link(self, places: np.ndarray, of: np.ndarray) -> None:
        """Link the members of new classes; places are in order within each."""
        same = of[1:] == of[:-1]
        self.next[places] = self.prev[places] = -1
        a, b = places[:-1][same], places[1:][same]
        self.next[a], self.prev[b] = b, a
        self._note(a, b)

    def _note(self, a: np.ndarray, b: np.ndarray) -> None:
        gap = b - a
        some = (gap > self.level - 1) & (gap <= self.limit[a]) & (self.size[self.of[a]] >= self.least)
        if some.any():
            self.squares.add(a[some], gap[some])

    def _unlink(self, moved: np.ndarray) -> None:
        """Take places, in order within each class, out of their classes' lists: neighbours that go together are one cut."""
        joined = self.next[moved[:-1]] == moved[1:]
        first = np.concatenate(([True], ~joined))
        last = np.concatenate((~joined, [True]))
        a, b = self.prev[moved[first]], self.next[moved[last]]
        self.next[a[a >= 0]] = b[a >= 0]
        self.prev[b[b >= 0]] = a[b >= 0]
        both = (a >= 0) & (b >= 0)
        self._note(a[both], b[both])

    def found(self) -> np.ndarray:
        """Places where a square with a period of the present length starts, in order."""
        places = self.squares.pop(self.level)
        return places[(self.next[places] - places == self.level) & (self.size[self.of[places]] >= self.least)]

    def refine(self) -> bool:
        """Go on to factors that are one word longer; false once no class can be split any more."""
        splitting = self.order[_ranges(self.start[self.small], self.size[self.small])]
        places = splitting - 1
        alive = (places >= 0) & (self.size[self.of[places]] >= self.least) & (self.limit[places] > self.level)
        places, by = places[alive], self.of[splitting[alive]]
        self.level += 1
        self.small = np.empty(0, np.int64)
        if not len(places):
            return False
        own = self.of[places]
        order = np.lexsort((places, by, own))
        places, by, own = places[order], by[order], own[order]
        heads, tops = _heads(own, by), _heads(own)
        moving = np.diff(np.append(tops, len(own)))  # of each class that is touched
        whole = (moving == self.size[own[tops]]) & (np.diff(np.append(np.searchsorted(heads, tops), len(heads))) == 1)
        if whole.any():  # all members go on alike: no split
            stays = np.repeat(~whole, moving)
            places, by, own = places[stays], by[stays], own[stays]
            if not len(places):
                return True
            heads, tops = _heads(own, by), _heads(own)
            moving = np.diff(np.append(tops, len(own)))
        touched = own[tops]
        self._unlink(places[np.lexsort((places, own))])
        # moved places go to the front of their class, in order of their new classes
        slots = _ranges(self.start[touched], moving)
        front = np.repeat(self.start[touched] + moving, moving)
        there, were = self.order[slots], self.at[places]
        if len(places) > len(self.of) // 8:
            going = np.zeros(len(self.of), bool)
            going[places] = True
            leaving = ~going[there]
        else:
            leaving = ~np.isin(there, places)
        holes = were[were >= front]  # as many in each class as stay of those that stood at its front
        self.order[holes], self.at[there[leaving]] = there[leaving], holes
        self.order[slots], self.at[places] = places, slots
        # new classes; where a class is gone whole, the first of its parts takes its number
        sizes = np.diff(np.append(heads, len(own)))
        first = np.searchsorted(heads, tops)
        family = np.repeat(np.arange(len(tops)), np.diff(np.append(first, len(heads))))
        rest = self.size[touched] - moving
        gone = np.zeros(len(heads), bool)
        gone[first] = rest == 0
        number = np.where(gone, own[heads], self.classes - 1 + np.cumsum(~gone))
        self.classes += int((~gone).sum())
        self.start[touched] += moving
        self.size[touched] = rest
        self.start[number], self.size[number] = slots[heads], sizes
        self.of[places] = np.repeat(number, sizes)
        self._link(places, np.repeat(number, sizes))
        # all parts but the largest split others
        parts = np.concatenate((number, touched[rest > 0]))
        family = np.concatenate((family, np.flatnonzero(rest > 0)))
        order = np.lexsort((-self.size[parts], family))
        largest = np.zeros(len(parts), bool)
        largest[order[_heads(family[order])]] = True
        self.small = parts[~largest]
        return True


def runs(words: np.ndarray, limit: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, in order of start, then period."""
    if not len(words):
        return (np.empty(0, np.int64),) * 3
    classes, out = Refinement(words, limit, exponent), []
    while True:
        period, places = classes.level, classes.found()
        if len(places):
            new = np.concatenate(([True], np.diff(places) > period))
            start, last = places[new], places[np.append(np.flatnonzero(new)[1:] - 1, len(places) - 1)]
            length = last + 2 * period - start
            keep = length >= max(least, exponent * period)
            out.append((start[keep], length[keep], np.full(keep.sum(), period)))
        if not classes.refine():  # classes stay as they are from here on
            if not classes.squares.waiting:
                break
            classes.level = min(classes.squares.waiting)
    start, length, period = (np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in range(3))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _numbers(texts: list[list[bytes]], exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts as numbers that no two texts share, greatest periods, and where texts begin; a number of its
    own ends each text."""
    numbers, begin, limit, known = [], [], [], 0
    for found in texts:
        own: dict[bytes, int] = {}
        begin.append(len(numbers))
        numbers += [own.setdefault(w, known + len(own)) for w in found]
        known += len(own)
        numbers.append(known)
        known += 1
        limit.append(len(found) // exponent)
    begin = np.array(begin, np.int64)
    return np.array(numbers, np.int64), np.repeat(np.array(limit, np.int64), np.diff(np.append(begin, len(numbers)))), begin


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find(text_col: str, exponent: int, least: int):
    def done(rows: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        words, limit, begin = _numbers(texts, exponent)
        start, length, period = runs(words, limit, exponent, least)
        text = np.searchsorted(begin, start, side="right") - 1
        ends = np.searchsorted(text, np.arange(len(texts) + 1))
        fields = [pa.array(start - begin[text]), pa.array(length), pa.array(period)]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(RUN)))
        collapsed = []
        for i, found in enumerate(texts):
            if ends[i] == ends[i + 1]:
                collapsed.append(b" ".join(found).decode())
                continue
            cut = np.zeros(len(found) + 1, np.int64)
            s = slice(ends[i], ends[i + 1])
            np.add.at(cut, start[s] - begin[i] + period[s], 1)
            np.add.at(cut, start[s] - begin[i] + length[s], -1)
            keep = np.cumsum(cut)[:-1] == 0
            collapsed.append(b" ".join([found[k] for k in np.flatnonzero(keep).tolist()]).decode())
        n = pa.array([len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([rows, n, lists, pa.array(collapsed, pa.string())], names=["row", "n_words", "runs", "collapsed"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            texts, words, at = [], 0, 0
            for i in range(len(column)):
                found = (column[i].as_py() or "").encode().split()  # splits on space and 0x09-0x0D, nothing else
                if texts and words + len(found) > BATCH:
                    yield done(batch.column(0).slice(at, len(texts)), texts)
                    texts, words, at = [], 0, i
                texts.append(found)
                words += len(found)
            if texts:
                yield done(batch.column(0).slice(at, len(texts)), texts)

    return run


def find_runs(docs: DataFrame, text_col: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """docs with n_words, runs and collapsed.

    runs: array of struct<start, length, period>, by start, then period: maximal stretches of words (from 0) whose
    smallest period is repeated `exponent` times at least and which have `least` words at least. collapsed: the words
    that no run contains after its first period, joined by spaces. Words are parts between space and 0x09-0x0D; a null
    text has none and collapses to an empty one. Rows are independent of each other, so equal ids and repeated rows
    don't matter. Columns with the added names are replaced. An empty table gives an empty result.
    """
    if exponent < 2:
        raise ValueError("a run repeats its period twice at least")
    added = ("n_words", "runs", "collapsed")
    own = [c for c in docs.columns if c.lower() not in added]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(text_col).cast("string").alias("text"))
    span = T.StructType().add("start", T.LongType()).add("length", T.LongType()).add("period", T.LongType())
    out = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(span)), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(_find(text_col, exponent, least), out).select("row.*", *added)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in documents with crc32(doc_id) % 10 = 0 the words from a place on repeat a period."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    hit = docs.select("doc_id", "text", h.alias("h")).withColumn("g", F.floor(F.col("h") / 10)).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    hit = hit.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    hit = hit.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    repeated = F.transform("w", lambda w, i: F.when(i >= F.col("a"), F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(w))
    return hit.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def runs_query(spark, sf_dir: str) -> DataFrame:
    found = find_runs(planted(table(spark, sf_dir, "documents")))
    ahead = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]  # noqa: E731  sign: whose exponent is greater
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(ahead(r, a) > 0, r).otherwise(a))  # the first of equals stays
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    milli = F.expr("best.length * 1000 div best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


#: crc32 of the decimal doc_id by its definition, a byte and then a bit at a time.
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda s, c: list_reduce(list_concat([xor(s, c)], range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"

RUNS_SQL = rf"""
with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
h as (select doc_id, ws, len(ws) as n, {_CRC} as h from w),
g as (select *, h // 10 as g, case when h % 10 = 0 and n > 0 then (h // 10) % n end as a from h),
d as (select doc_id, n, case when a is null then ws else list_transform(range(0, n), lambda i: case when i < a then ws[i + 1] else ws[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] end) end as ws from g),
t as (select doc_id, n, j as i, ws[j + 1] as word from d, lateral unnest(range(0, n)) u(j)),
e as (select x.doc_id, x.i, y.i - x.i as q from t x join t y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and (y.i - x.i) * 4 <= x.n),
s as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from e),
l as (select doc_id, min(i) as start, count(*) + q as length, q as period from s group by doc_id, q, island having count(*) >= 3 * q and count(*) + q >= 6),
r as (select * from l where not exists (select 1 from l o where o.doc_id = l.doc_id and o.period < l.period and o.start <= l.start and o.start + o.length >= l.start + l.length)),
b as (select *, row_number() over (partition by doc_id order by length::DOUBLE / period desc, start, period) as k from r),
m as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as told from r group by doc_id),
c as (select distinct doc_id, unnest(range(start + period, start + length)) as i from r),
k as (select t.doc_id, string_agg(word, ' ' order by t.i) filter (where c.i is null) as kept from t left join c on c.doc_id = t.doc_id and c.i = t.i group by t.doc_id)
select d.doc_id, coalesce(n_runs, 0)::BIGINT as n_runs, b.start, b.length, b.period, (1000 * b.length // b.period)::BIGINT as exponent_milli,
       sha256(coalesce(told, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256, n::BIGINT as n_words
from d left join m on m.doc_id = d.doc_id left join b on b.doc_id = d.doc_id and b.k = 1 left join k on k.doc_id = d.doc_id
"""
