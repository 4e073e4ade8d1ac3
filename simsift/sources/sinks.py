"""Sinks: indexes in versions, projector files, and training metrics.

An index is a folder of tables and of versions. A version is a list of the tables' parts; it exists once its list has
its name, so a writer that dies leaves the one before, and a reader sees one version whatever is written meanwhile.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import removed, stored


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions of an index, in order."""
    fs, at = _fs(spark, f"{path}/versions")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/versions/{version:012d}.json", wholetext=True).first()[0])


def _published(spark: SparkSession, path: str, manifest: dict, version: int) -> None:
    """Make a version the latest: its list of tables, written aside, takes its name in one rename."""
    fs, aside = _fs(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    _, final = _fs(spark, f"{path}/versions/{version:012d}.json")
    if fs.exists(final) or not fs.rename(aside, final):
        fs.delete(aside, False)
        raise RuntimeError(f"version {version} of {path} was published by another writer")


def save_index(tables: dict[str, DataFrame], settings: dict, path: str) -> int:
    """Write tables and settings as a new version, which it returns. Versions before it stay as they are, and stay the
    latest for a reader until all tables are written."""
    return _add(tables, settings, path, {})


def append_index(tables: dict[str, DataFrame], path: str, settings: dict | None = None) -> int:
    """A version that holds the latest one's tables too, without writing them again: rows are added to tables of the same
    name. Costs what the new rows cost."""
    spark = next(iter(tables.values())).sparkSession
    latest = _manifest(spark, path, versions(spark, path)[-1])
    return _add(tables, settings or latest["settings"], path, latest["tables"])


def _add(tables: dict[str, DataFrame], settings: dict, path: str, known: dict) -> int:
    spark = next(iter(tables.values())).sparkSession
    version = max(versions(spark, path), default=0) + 1
    listed = {n: {"schema": t["schema"], "parts": list(t["parts"])} for n, t in known.items()}
    for name, df in tables.items():
        part = f"tables/{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{path}/{part}")
        listed.setdefault(name, {"schema": df.schema.json(), "parts": []})["parts"].append(part)
    _published(spark, path, {"settings": settings, "tables": listed}, version)
    return version


def load_index(spark: SparkSession, path: str, *names: str, version: int | None = None) -> tuple[dict[str, DataFrame], dict]:
    """Tables, all of them if none is named, and settings of the latest version, or of a given one. What later versions
    add is not seen."""
    found = _manifest(spark, path, version or versions(spark, path)[-1])
    tables = {}
    for name in names or found["tables"]:
        t = found["tables"][name]
        tables[name] = spark.read.schema(T.StructType.fromJson(json.loads(t["schema"]))).parquet(*[f"{path}/{p}" for p in t["parts"]])
    return tables, found["settings"]


def vacuum_index(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove all versions but the last `keep`, and tables that none of these lists, those of writers that died too; how
    many tables went. Nobody may write meanwhile, and readers of older versions lose them."""
    every = versions(spark, path)
    used = {p for v in every[-keep:] for t in _manifest(spark, path, v)["tables"].values() for p in t["parts"]}
    for v in every[:-keep]:
        removed(spark, f"{path}/versions/{v:012d}.json")
    fs, at = _fs(spark, f"{path}/tables")
    gone = [n for n in (f"tables/{f.getPath().getName()}" for f in fs.listStatus(at)) if n not in used]
    for n in gone:
        removed(spark, f"{path}/{n}")
    return len(gone)


def write_projector(rows: DataFrame, path: str, vector: Column, *meta: Column) -> None:
    """Vectors and their descriptions as two tab-separated tables, rows in the same order, by the descriptions.

    vecs has no header, meta has one.
    """
    ordered = stored(rows.select(F.array_join(F.transform(vector, lambda x: x.cast("string")), "\t").alias("vec"), *meta), "projector")  # both writes sample and sort it
    names = ordered.columns[1:]
    ordered = ordered.orderBy(*names, "vec")
    ordered.select("vec").write.mode("overwrite").text(f"{path}/vecs")
    ordered.select(*names).write.mode("overwrite").option("header", True).option("sep", "\t").csv(f"{path}/meta")


def read_projector(spark: SparkSession, path: str, meta: str) -> DataFrame:
    """Rows of write_projector's tables side by side, by their places: the columns of `meta`, a schema, and vec, an array of text."""
    vecs = _placed(spark.read.text(f"{path}/vecs"), F.split("value", "\t").alias("vec"))
    rows = _placed(spark.read.schema(meta).option("header", True).option("sep", "\t").csv(f"{path}/meta"), "*")
    return rows.join(vecs, "place").drop("place")


def _placed(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """Rows of files with their places from 1, over all files in order of name; a count for each file reaches the driver."""
    at = F.struct(F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("at")).alias("_at")
    named = rows.select(*columns, F.col("_metadata.file_name").alias("_file"), at)
    before, starts = 0, []
    for r in named.groupBy("_file").count().orderBy("_file").collect():
        starts.append((r["_file"], before))
        before += r["count"]
    starts = rows.sparkSession.createDataFrame(starts, "_file string, _start long")
    own = F.row_number().over(Window.partitionBy("_file").orderBy("_at"))
    return named.withColumn("_row", own).join(starts, "_file").withColumn("place", F.col("_start") + F.col("_row")).drop("_file", "_start", "_row", "_at")


def write_results(found: DataFrame, path: str) -> None:
    """Search results (query, place, id, similarity, title) as a tab-separated table with a header, in order of query and place."""
    ordered = found.select("query", "place", "id", "similarity", "title").orderBy("query", "place")
    ordered.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_observed(df: DataFrame, path: str, **aggregates: Column) -> dict:
    """Write df and return the aggregates over all its rows, which the same pass has counted."""
    seen = Observation()
    df.observe(seen, *[a.alias(n) for n, a in aggregates.items()]).write.mode("overwrite").parquet(path)
    return seen.get


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append (epoch, name, value) rows to the run's metrics."""
    metrics.write.mode("append").parquet(path)


def mean_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("epoch", "name").agg(F.avg("value").alias("value"))
