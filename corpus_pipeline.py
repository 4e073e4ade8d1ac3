"""A corpus pipeline over the documents table; each stage is one operator of simsift.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as
Parquet and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simsift.llm.bpe import digests
from simsift.llm.common import stored, table
from simsift.llm.exact import drop_exact
from simsift.llm.mixing import mix
from simsift.llm.simhash import drop_near
from simsift.llm.toxicity import score_toxicity, train

#: Words of a shingle and least Jaccard similarity in the near-duplicate stage.
WORDS, SIMILARITY = 5, 0.8


def _shielded(docs: DataFrame, *read: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but those a stage reads under names that no operator adds, and what gives them back."""
    names = {c: c if c in read else f"column {i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in names.items()])
    return plain, lambda df: df.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic. It learns from all labels of the documents at hand.

    A null text counts as empty and is judged by the intercept; rows with a null doc_id have no label but are judged.
    Repeated rows are all kept or all dropped. All columns stay as they are, whatever their names. Without labels, or
    with one kind only, the share of toxic ones decides. An empty table gives an empty result.
    """
    model = train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    plain, back = _shielded(docs, "doc_id", "text")
    return back(score_toxicity(plain, model).where("predicted = 0"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the smallest doc_id, null last; of repeated rows, one.

    A null text equals an empty one, and they are one group. All columns stay as they are, whatever their names. An
    empty table gives an empty result.
    """
    plain, back = _shielded(docs, "doc_id", "text")
    return back(drop_exact(plain))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: those that a chain of pairs connects whose sets of shingles of
    five words have a Jaccard similarity of 0.8 at least. SimHash probes find the pairs, the sets verify them.

    The one with the smallest doc_id stays, null last; of repeated rows, one. Null and empty texts, and texts without
    words, are one group. All columns stay as they are, whatever their names. An empty table gives an empty result.
    """
    plain, back = _shielded(docs, "doc_id", "text")
    return back(drop_near(plain, words=WORDS, similarity=SIMILARITY))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it; those it leaves out go.

    Null and empty texts take no words and stay once. A null source is one of its own. Repeated rows are taken each by
    itself. All columns stay as they are, whatever their names. An empty table gives an empty result.
    """
    plain, back = _shielded(docs, "doc_id", "text", "source")
    mixed = mix(plain).where("copies > 0")
    return back(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, repeated ones too.

    A null text counts as empty: no tokens. Other columns are not read. An empty table gives an empty result.
    """
    import public_tokenizers

    rows = docs.select("doc_id", F.col("text").alias("body"))
    return digests(rows, "body", public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing", mixing),
    ("BPE encoding", encoding),
]

#: Model fitting and tokenization have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{i + 1}-{name.split()[0]}")
    return docs
