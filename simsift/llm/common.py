"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, shared_dir, stored, temporary

__all__ = ["SPACE", "crc_mod", "numbered", "partitions", "scratch", "shared_dir", "stored", "table", "temporary", "trim", "trimmed"]

#: White space of every contract of this package: space and 0x09-0x0D, nothing else.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession, total_bytes: float = 0, target: int = 64 << 20) -> int:
    """Shuffle partitions for so many bytes: the session's number, or more where a partition would exceed target."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total_bytes / target))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a column written as text, modulo n; null where the column is null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def trimmed(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """An Arrow function of a task that gives back to the system what it has used: workers live on from stage to stage, and
    what they once held counts against the executor until then."""

    def outer(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return outer


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _plain_scan(df: DataFrame) -> bool:
    """df is one path of files, filtered and projected: its rows are rows of the files, each once at most."""
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if node.getClass().getSimpleName() != "LogicalRelation" or node.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return node.relation().location().rootPaths().size() == 1


def numbered(df: DataFrame, row: str, place: str) -> DataFrame:
    """All columns of df as the struct `row`, and `place`, a struct of two longs that tells rows apart and is the same
    each time the table is read. For rows of files it is the file and the row's number in it. Rows that may come several
    times from one row of a file (joins, explode, unions, paths given twice), or aren't files' at all, are stored first."""
    own = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias(row)
    if _plain_scan(df) and "_metadata" not in map(str.lower, df.columns):
        at = F.struct(F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").cast("long").alias("at"))
        try:
            out = df.select(own, at.alias(place))
            out.schema  # noqa: B018  fails here, where the format has no row numbers
            return out
        except AnalysisException:
            pass
    at = F.struct(F.spark_partition_id().cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))
    return stored(df.select(own, at.alias(place)), "numbered")
