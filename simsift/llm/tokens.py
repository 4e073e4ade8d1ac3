"""Token ids in files of directly addressable codes.

An id is split into chunks of 8 bits, lowest first. Level k holds the k-th chunk of all ids that have one,
a bitmap that tells which of them continue, and a rank directory over the bitmap: the place of an id on
level k+1 is the number of continuing ids before it. Any id is read by a bit and a rank per level;
nothing else is decoded.

A file holds shards in ascending order of the documents' ids: a range partition of the table in order,
each cut into shards of bounded size. Files are Parquet, as Spark writes no other binary rows to every
store; a shard's codes are one binary value in the layout of DirectCodes.dump.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder
from .common import partitions, scratch, stored, table

MAGIC = b"DAC1"
#: File parts whose starts are broadcast at most; those of more are joined like any table.
PARTS = 100_000
#: Places of the whole stream that are joined with the shards as one key.
BLOCK = 1 << 20
#: Bits of the bitmap per entry of the rank directory.
RANK = 512
#: Ids after which a shard ends: what one look-up reads. Files are not compressed, so no look-up decodes more.
SHARD = 1 << 16


class DirectCodes:
    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """levels: chunks (uint8), bitmap (uint8, lowest bit first), continuing ids before each RANK bits (uint32)."""
        self.levels = levels

    @classmethod
    def of(cls, ids: np.ndarray) -> DirectCodes:
        levels, rest = [], np.asarray(ids, np.uint32)
        while True:
            more = rest > 0xFF
            bitmap = np.packbits(more, bitorder="little")
            ones = np.add.reduceat(np.bitwise_count(bitmap), np.arange(0, len(bitmap), RANK // 8), dtype=np.uint32) if len(bitmap) else np.empty(0, np.uint32)
            levels.append((rest.astype(np.uint8), bitmap, np.concatenate(([0], np.cumsum(ones)[:-1])).astype(np.uint32) if len(ones) else ones))
            rest = rest[more] >> np.uint32(8)
            if not len(rest):
                return cls(levels)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def rank(self, level: int, i: int) -> int:
        """Continuing ids before place i of a level."""
        chunks, bitmap, before = self.levels[level]
        if i >= len(chunks):
            return len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else 0
        block = i // RANK
        lead = bitmap[block * RANK // 8 : i // 8]
        return int(before[block]) + int(np.bitwise_count(lead).sum()) + (int(bitmap[i // 8]) & ((1 << i % 8) - 1)).bit_count()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not int(bitmap[i // 8]) >> i % 8 & 1:
                break
            i = self.rank(k, i)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b; only their own chunks are read."""
        out, at = np.zeros(b - a, np.uint32), np.arange(b - a)
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            if a >= b:
                break
            out[at] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * k)
            more = np.unpackbits(bitmap[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 :][: b - a].astype(bool)
            at = at[more]
            a = self.rank(k, a) if len(at) else 0
            b = a + len(at)
        return out

    def dump(self) -> bytes:
        """MAGIC, number of levels, then per level: number of chunks (u64), chunks, bitmap, rank directory. Little-endian."""
        out = [MAGIC, struct.pack("<I", len(self.levels))]
        for chunks, bitmap, before in self.levels:
            out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bitmap.tobytes(), before.astype("<u4").tobytes()]
        return b"".join(out)

    @classmethod
    def load(cls, data: bytes) -> DirectCodes:
        if data[:4] != MAGIC:
            raise ValueError("not a shard of directly addressable codes")
        at, levels = 8, []
        for _ in range(struct.unpack_from("<I", data, 4)[0]):
            (n,) = struct.unpack_from("<Q", data, at)
            at, sizes = at + 8, ((np.uint8, n), (np.uint8, -(-n // 8)), (np.dtype("<u4"), -(-n // RANK)))
            level = []
            for kind, k in sizes:
                level.append(np.frombuffer(data, kind, k, at))
                at += level[-1].nbytes
            levels.append(tuple(level))
        return cls(levels)


def _write(tokenizer: str, end_id: int, id_type: pa.DataType, shard: int) -> Callable:
    names = ["part", "before", "n_tokens", "ids", "lengths", "codes"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part, before, docs, codes, size = None, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(codes), "<u4")
            values = [part], [before], [len(ids)], [docs], [[len(c) // 4 for c in codes]], [DirectCodes.of(ids).dump()]
            kinds = pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                part = b.column(2)[0].as_py() if part is None else part
                for doc, ids in zip(b.column(0).to_pylist(), enc.encode([x or "" for x in b.column(1).to_pylist()]), strict=True):
                    docs.append(doc)
                    codes.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= shard:
                        yield flush()
                        before, docs, codes, size = before + size, [], [], 0
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> None:
    """Write the ids of all texts to path, in ascending order of id_col (nulls last), each text followed by end_id.

    A null text counts as empty and is written as its end id alone; repeated rows are written again, rows with equal
    ids in any order; other columns of docs are not written. An empty table gives files without shards.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.withColumn("tie", F.xxhash64("text"))  # rows without an id, or with the same, need not be one range
    order = F.asc_nulls_last("id"), F.col("tie")
    ranged = rows.repartitionByRange(partitions(docs.sparkSession, total), *order).sortWithinPartitions(*order)
    ranged = ranged.select("id", "text", F.spark_partition_id().alias("part"))
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("before", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.ArrayType(kind)),
            T.StructField("lengths", T.ArrayType(T.LongType())),
            T.StructField("codes", T.BinaryType()),
        ]
    )
    ranged.mapInArrow(_write(tokenizer, end_id, to_arrow_type(kind), shard), schema).write.option("compression", "none").parquet(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards of path with `start`, the number of ids in all shards before. One sum per file partition reaches the driver."""
    rows = spark.read.parquet(path)
    sums = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts, at = [], 0
    for part, n in sums:
        starts.append((part, at))
        at += n
    first = spark.createDataFrame(starts, "of int, offset long")
    first = F.broadcast(first) if len(starts) <= PARTS else first
    return rows.join(first, F.col("part") == F.col("of")).withColumn("start", F.col("offset") + F.col("before")).drop("of", "offset")


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            at, start, codes = 0, b.column(1)[i].as_py(), DirectCodes.load(b.column(3)[i].as_py())
            lengths, starts, found = b.column(2)[i].as_py(), [], []
            for n in lengths:
                found.append(codes.slice(at, at + n).astype("<u4").tobytes())
                starts.append(start + at)
                at += n
            yield pa.RecordBatch.from_arrays(
                [b.column(0)[i].values, pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(found, pa.binary()), pa.array(map(zlib.crc32, found), pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids, ids_crc32) of every document in the files; ids little-endian unsigned 32-bit."""
    rows = shards(spark, path)
    kind = rows.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind)])
    for name, t in (("start", T.LongType()), ("n_tokens", T.LongType()), ("ids", T.BinaryType()), ("ids_crc32", T.LongType())):
        schema = schema.add(name, t)
    return rows.select("ids", "start", "lengths", "codes").mapInArrow(_documents, schema)


def _lookup(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            start, codes, at = b.column(0)[i].as_py(), DirectCodes.load(b.column(1)[i].as_py()), b.column(2)[i].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([codes[p - start] for p in at], pa.int64())], names=["position", "token"])


def read_tokens(spark: SparkSession, path: str, positions: list[int] | DataFrame) -> DataFrame:
    """(position, token) of the given places in the whole stream, by random access, each place once; places outside it, and
    null ones, give no row. positions: a list, or a DataFrame with a column `position`.

    Places are gathered by shard first, without the codes; then each shard that is asked for is read once, where it lies
    (or sent on once, if more than PARTS shards are asked for).
    """
    wanted = positions if isinstance(positions, DataFrame) else spark.createDataFrame([(int(p),) for p in positions], "position long")
    wanted = wanted.select(F.col("position").cast("long").alias("position")).distinct()
    rows = shards(spark, path)
    end = F.col("start") + F.col("n_tokens")
    block = lambda at: F.floor(at / BLOCK)
    spread = rows.select("part", "before", "start", "n_tokens", F.explode(F.sequence(block(F.col("start")), block(end - 1))).alias("block"))
    hit = spread.join(wanted.withColumn("block", block(F.col("position"))), "block").where((F.col("position") >= F.col("start")) & (F.col("position") < end))
    hit = stored(hit.groupBy("part", "before").agg(F.collect_list("position").alias("positions")), "token-hits")  # a shard's ids at most
    asked = F.broadcast(hit) if hit.count() <= PARTS else hit
    return rows.join(asked, ["part", "before"]).select("start", "codes", "positions").mapInArrow(_lookup, "position long, token long")


def tokens_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
