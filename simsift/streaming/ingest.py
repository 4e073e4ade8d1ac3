"""Indexing a stream of posts, and answering a stream of queries, with the batch operators.

Each micro-batch is written under its own number, so a batch that is run again after a failure replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as tx
from ..operators.minhash import MinHash, MinHashIndex


def title_stream(rows: DataFrame, id_col: str = "id", title_col: str = "title") -> DataFrame:
    """(id, tokens) of a stream of posts; posts without tokens are left out."""
    return rows.select(F.col(id_col).alias("id"), tx.tokens(F.col(title_col)).alias("tokens")).where(F.size("tokens") > 0)


def index_stream(titles: DataFrame, path: str, checkpoint: str, method: MinHash | None = None) -> StreamingQuery:
    """Write signatures of a stream of (id, tokens) to path/batch=n until the stream ends."""
    method = method or MinHash()

    def write(batch: DataFrame, number: int) -> None:
        method.signatures(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return titles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_index(spark: SparkSession, path: str, method: MinHash | None = None) -> MinHashIndex:
    """The index over everything that index_stream has written; of repeated ids the last batch counts."""
    method = method or MinHash()
    rows = spark.read.parquet(path).groupBy("id").agg(F.max_by("sig", "batch").alias("sig"))
    return MinHashIndex.of_signatures(rows, method)


def search_stream(queries: DataFrame, index: MinHashIndex, path: str, checkpoint: str, limit: int = 10) -> StreamingQuery:
    """Write the results of a stream of queries (id, tokens) to path/batch=n."""

    def write(batch: DataFrame, number: int) -> None:
        index.search(batch, limit).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answers_stream(rows: DataFrame, lo: int = 1, hi: int = 0) -> DataFrame:
    """Posts of a stream with the answers that came before them, as attach_positional gives them for a whole dump.

    rows: (source, at, id, is_answer), sources being dumps whose rows arrive in order of `at`, in batches cut anywhere.
    The state of a source holds the answers that wait for the next post of the range lo to hi (without an end if hi is
    below lo), and how many posts there were. Returns (source, at, id, post_ordinal, answers), answers being ids, null
    without any; answers after the last post wait for ever. A source's batch is one task's, so a batch should be small.
    """
    kind = rows.schema["id"].dataType.simpleString()
    state = f"posts long, waiting array<{kind}>"

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        posts, waiting = held.get if held.exists else (0, [])
        waiting, out = list(waiting), []
        for r in pd.concat(list(parts)).sort_values("at").itertuples(index=False):
            if r.is_answer:
                waiting.append(r.id)
                continue
            posts += 1
            if posts >= max(lo, 1) and (hi < max(lo, 1) or posts <= hi):
                out.append((key[0], r.at, r.id, posts, waiting or None))
                waiting = []
        held.update((posts, waiting))
        yield pd.DataFrame(out, columns=["source", "at", "id", "post_ordinal", "answers"])

    schema = f"source string, at long, id {kind}, post_ordinal long, answers array<{kind}>"
    return rows.groupBy("source").applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream's rows to a folder until the stream ends; a batch that is run again is written once."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_index_stream(rows: DataFrame, path: str, checkpoint: str, method: MinHash | None = None) -> StreamingQuery:
    """Write parts of signatures of a stream of (id, token) to path/batch=n: tokens of a post may come in any batch."""
    method = method or MinHash()

    def write(batch: DataFrame, number: int) -> None:
        method.signatures_of_rows(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def word_counts(words: DataFrame, time_col: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Words of a stream by window of event time; rows later than `late` are dropped by the watermark."""
    return words.withWatermark(time_col, late).groupBy(F.window(time_col, window), "word").agg(F.count(F.lit(1)).alias("n"))
