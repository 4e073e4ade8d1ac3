"""Where intermediate tables go, and how they are written."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir; only where that is unset and Spark runs on one
    machine (tests) a folder of our own is chosen, and set for checkpoint() as well.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = sc.getCheckpointDir()
        if not found:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(f"/tmp/checkpoints/{uuid.uuid4().hex}")
            found = sc.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/simsift/{name}-{uuid.uuid4().hex}"


#: Paths of the tables that open blocks of temporary() have stored.
_OPEN: list[list[str]] = []


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df to the shared folder, in a folder for each value of `by`, and read it back: cuts the lineage, survives
    lost executors."""
    return _written(df, name, _OPEN[-1] if _OPEN else None, *by)


def _written(df: DataFrame, name: str, paths: list[str] | None, *by: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.partitionBy(*by).parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


class Kept:
    def __init__(self, outer: list[str] | None) -> None:
        self.outer = outer

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        """Store df where the block's end leaves it."""
        return _written(df, name, self.outer)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Kept]:
    """Tables stored inside the block are removed at its end; what is needed after it must be stored by what the block
    is given. A block that fails leaves its tables, for tasks may still read them."""
    paths: list[str] = []
    outer = _OPEN[-1] if _OPEN else None
    _OPEN.append(paths)
    try:
        yield Kept(outer)
    finally:
        _OPEN.remove(paths)
    for path in paths:
        removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder and all in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
