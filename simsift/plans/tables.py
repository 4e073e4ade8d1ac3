"""The driver's tables in the roles of posts, queries, vectors and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt anew where there are fewer partitions than cores: a small file is one split, and text costs time."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Some columns of a table with long texts, on all cores."""
    return spread(table(spark, sf_dir, name).select(*columns))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as posts: the text is both body and title."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.col("text").alias("title"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, tokens) of documents with at least one token."""
    return _tokens(spark, sf_dir).where(F.size("tokens") > 0)


def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, tokens) of documents with at least one token: all tokens of a text, not a title's first ones."""
    rows = texts(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), tx.clean_query(F.col("text")).alias("tokens"))
    return rows.where(F.size("tokens") > 0)


def kept_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """titles, written before empty ones are left out: filters, explosions and joins repeat the cleaning they stand on."""
    return stored(_tokens(spark, sf_dir), "titles").where(F.size("tokens") > 0)


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), tx.tokens(F.col("text")).alias("tokens"))


def bits(vector: Column) -> Column:
    """An embedding as bits: 1 where a component is positive."""
    return F.transform(vector, lambda v: F.when(v > 0, 1).otherwise(0))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec): embeddings as bits."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), bits(F.col("embedding")).alias("vec"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as rows of a dump: assistant turns are answers, the rest posts, in order of (conv_id, turn)."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
