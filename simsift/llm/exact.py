"""Exact dedup by distributed MSD radix partitioning.

Texts are split by their leading bytes, then by the bytes after those, until a group is a single text
or its texts have ended; texts that end in the same group are equal, so no digest decides anything.

Distributed part: a digit is a run of bytes (16 at first, wider further on). Groups that outweigh
`share` of a partition are few - at most all bytes over that weight - and only those are split again
over the whole table, by counting digits with map-side aggregation. A heavy group whose texts have
ended is one class: its rows are counted and never brought together. Every other row goes, by the
group it stopped in, to a partition that is bounded in bytes, and the recursion ends there in memory.
Texts move once at most; what is broadcast is the heavy groups, whose number is bounded as above.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import SPACE, numbered, partitions, stored, table, trimmed

#: Bytes of the first digits; each further one is twice as wide as the one before it.
WIDTHS = (16, 64, 256, 1024, 4096)


def width_of(level: int) -> int:
    return WIDTHS[level] if level < len(WIDTHS) else WIDTHS[-1] << (level - len(WIDTHS) + 1)


#: A group is heavy beyond this share of an average partition's bytes.
HEAVY = 0.5
#: Bytes that a row weighs besides its text.
ROW = 64
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def radix_classes(texts: list[bytes], width: int = 16) -> list[list[int]]:
    """Places of equal texts, by splitting on successive runs of bytes until groups are single or ended."""
    done, open_ = [], [(list(range(len(texts))), 0, width)]
    while open_:
        group, at, width = open_.pop()
        if len(group) == 1:
            done.append(group)
            continue
        parts: dict = {}
        for i in group:
            digit = texts[i][at : at + width]
            parts.setdefault((digit, len(texts[i]) <= at + width), []).append(i)
        for (_, ended), part in parts.items():
            if ended:
                done.append(part)
            else:
                open_.append((part, at + width, 2 * width))
    return done


@dataclass
class Trie:
    """Heavy groups. Node 0 is the whole table; a child is a digit with whether all texts of it have ended there."""

    children: dict = field(default_factory=dict)
    #: Ended heavy groups: node to the id that stays, its row, and the number of rows.
    leaves: dict = field(default_factory=dict)
    nodes: int = 1

    def descend(self, text: bytes) -> tuple[int, bytes, bool, int]:
        """Node where the text leaves the trie (an ended group, or one without such a child), and its digit there, whether
        the text ends in it, and the level."""
        node, at, level = 0, 0, 0
        while True:
            width = width_of(level)
            digit, ended = text[at : at + width], len(text) <= at + width
            child = self.children.get((node, digit, ended))
            if child is None or child in self.leaves:
                return node if child is None else child, digit, ended, level
            node, at, level = child, at + width, level + 1


def _normal(column: pa.Array) -> list[bytes]:
    """Texts after each run of white space became one space; null is empty."""
    return pc.replace_substring_regex(pc.fill_null(column, ""), SPACE, " ").cast(pa.binary()).to_pylist()


#: Place of a row, as `numbered` gives it.
PLACE = pa.struct([("file", pa.int64()), ("at", pa.int64())])


def _places(column: pa.Array) -> list[tuple[int, int]]:
    return list(zip(column.field("file").to_pylist(), column.field("at").to_pylist(), strict=True))


def _earlier(a: tuple, b: tuple) -> bool:
    """Order of (id is null, id, place): null ids last."""
    return a[0] < b[0] if a[0] != b[0] else a[2] < b[2] if a[0] else a[1:] < b[1:]


def _count(shipped, level: int, id_type: pa.DataType):
    """Weight, rows and first row of each digit that follows a node of the level."""
    names = ["node", "digit", "ended", "weight", "n", "id", "seen_at"]
    kinds = pa.int32(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), id_type, PLACE

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, trie = {}, shipped.value

        def flush() -> pa.RecordBatch:
            rows = [(*k, v[0], v[1], v[2][1], dict(zip(("file", "at"), v[2][2], strict=True))) for k, v in found.items()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for text, doc, seen in zip(_normal(b.column(1)), b.column(0).to_pylist(), _places(b.column(2)), strict=True):
                node, digit, ended, depth = trie.descend(text)
                if depth == level and node not in trie.leaves:
                    first = (doc is None, doc, seen)
                    old = found.get((node, digit, ended))
                    if old is None:
                        found[node, digit, ended] = [len(text) + ROW, 1, first]
                    else:
                        old[0] += len(text) + ROW
                        old[1] += 1
                        if _earlier(first, old[2]):
                            old[2] = first
            if len(found) > 100_000:
                yield flush()
        if found:
            yield flush()

    return run


def _light(shipped, text_col: str):
    """Rows outside ended heavy groups, with the number of the group they stopped in."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shipped.value
        for b in batches:
            keep, group = [], []
            for i, text in enumerate(_normal(b.column(0).field(text_col))):
                node, digit, _, _ = trie.descend(text)
                if node not in trie.leaves:
                    keep.append(i)
                    group.append(zlib.crc32(digit, node) - (1 << 31))  # says where a row goes, not what it equals
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(group, pa.int32())], names=["row", "group"])

    return run


def _output(columns: list[str], own: pa.StructArray, keep: list, size: list, kept: list, sha: list, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    arrays = [own.field(c) for c in columns]
    arrays += [pa.array(keep, id_type), pa.array(size, pa.int64()), pa.array(kept, pa.bool_()), pa.array(sha, pa.string())]
    yield from pa.Table.from_arrays(arrays, names=[*columns, *ADDED]).to_batches(max_chunksize=2000)


def _heavy(shipped, text_col: str, columns: list[str], id_type: pa.DataType):
    """Rows of ended heavy groups, finished where they are read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, digests = shipped.value, {}
        for b in batches:
            keep, found, stays, sha = [], [], [], []
            for i, (text, seen) in enumerate(zip(_normal(b.column(0).field(text_col)), _places(b.column(1)), strict=True)):
                node = trie.descend(text)[0]
                if node in trie.leaves:
                    if node not in digests:
                        digests[node] = hashlib.sha256(text).hexdigest()
                    keep.append(i)
                    found.append(trie.leaves[node])
                    stays.append(seen == trie.leaves[node][1])
                    sha.append(digests[node])
            if keep:
                own = b.column(0).take(pa.array(keep, pa.int64()))
                yield from _output(columns, own, [f[0] for f in found], [f[2] for f in found], stays, sha, id_type)

    return run


def _finish(id_col: str, text_col: str, columns: list[str], id_type: pa.DataType):
    """The rest of the recursion, in memory."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b.column(0) for b in batches if b.num_rows]
        if not got:
            return
        own = pa.concat_arrays(got)
        del got
        text, ids = _normal(own.field(text_col)), own.field(id_col).to_pylist()
        n = len(text)
        keep, size, kept, sha = [None] * n, [0] * n, [False] * n, [""] * n
        for group in radix_classes(text):
            best = min(group, key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
            kept[best], digest = True, hashlib.sha256(text[best]).hexdigest()
            for i in group:
                keep[i], size[i], sha[i] = ids[best], len(group), digest
        del text
        yield from _output(columns, own, keep, size, kept, sha, id_type)

    return run


def mark_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256.

    Texts are equal when they are after each run of white space (space, 0x09-0x0D) became one space; a
    null text is an empty one. Of equal texts exactly one row is kept: the one with the smallest id, null
    ids last; of rows that also share that id, any one. Columns of docs with the added names are replaced.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c.lower() not in ADDED]
    kind = docs.schema[id_col].dataType
    id_type = to_arrow_type(kind)
    rows = numbered(docs.select(*[F.col(f"`{c}`") for c in own]), "row", "seen_at")
    ship = spark.sparkContext.broadcast
    counted = T.StructType([T.StructField("node", T.IntegerType()), T.StructField("digit", T.BinaryType()), T.StructField("ended", T.BooleanType())])
    counted = counted.add("weight", T.LongType()).add("n", T.LongType()).add("id", kind).add("seen_at", rows.schema["seen_at"].dataType)

    trie, level, total, parts = Trie(), 0, None, None
    while True:
        looked = rows.select(F.col("row")[id_col].alias("id"), F.col("row")[text_col].cast("string").alias("text"), "seen_at")
        counts = looked.mapInArrow(trimmed(_count(ship(trie), level, id_type)), counted).groupBy("node", "digit", "ended")
        first = F.struct(F.col("id").isNull().alias("none"), "id", "seen_at")
        counts = counts.agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"), F.min(first).alias("first"))
        if total is None:
            counts = stored(counts, "exact-digits")
            total = counts.agg(F.sum("weight")).first()[0] or 0
            parts = partitions(spark, total)
        heavy = counts.where(F.col("weight") > HEAVY * total / parts).collect()  # parts / HEAVY rows at most
        for r in heavy:
            trie.children[r["node"], bytes(r["digit"]), r["ended"]] = trie.nodes
            if r["ended"]:
                trie.leaves[trie.nodes] = r["first"]["id"], tuple(r["first"]["seen_at"]), r["n"]
            trie.nodes += 1
        level += 1
        if all(r["ended"] for r in heavy):
            break

    out = T.StructType([*[docs.schema[c] for c in own], T.StructField("keep_id", kind), T.StructField("group_size", T.LongType()), T.StructField("kept", T.BooleanType()), T.StructField("text_sha256", T.StringType())])
    known = ship(trie)
    light = rows.select("row").mapInArrow(_light(known, text_col), T.StructType([rows.schema["row"], T.StructField("group", T.IntegerType())]))
    light = light.repartition(parts, "group").select("row").mapInArrow(trimmed(_finish(id_col, text_col, own, id_type)), out)
    return light.union(rows.mapInArrow(_heavy(known, text_col, own, id_type), out)) if trie.leaves else light


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that mark_exact keeps, with the columns of docs."""
    return mark_exact(docs, id_col, text_col).where("kept").select(*[c for c in docs.columns if c.lower() not in ADDED])


def exact_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_exact(docs).select("doc_id", *ADDED)


EXACT_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = min(doc_id) over w as kept, sha256(body) as text_sha256
from n window w as (partition by body)
"""
