"""Training sets by name: each is a DataFrame with x and its target x_hat, flat matrices of doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions import text as tx
from .posts import body_words


def synthetic_words(ids: DataFrame, seed: int = 7) -> DataFrame:
    """(id, word): a word of letters a-z for each of ids (id); it goes on with probability 0.9, 100 letters at most. The same for a seed."""
    draw = lambda kind, i: F.pmod(F.xxhash64(F.lit(seed), F.lit(kind), F.col("id"), i), F.lit(1_000_003)) / 1_000_003.0
    length = F.least(F.lit(100), 1 + F.floor(F.log(draw("n", F.lit(0)) + 1e-9) / F.log(F.lit(0.9)))).cast("int")
    letters = F.transform(F.sequence(F.lit(1), length), lambda i: F.char((97 + F.floor(draw("c", i) * 26)).cast("long")))
    return ids.select("id", F.array_join(letters, "").alias("word"))


def word_set(words: DataFrame, feature: Callable[[Column], Column] = ft.histogram) -> DataFrame:
    """(id, x, x_hat) of single words."""
    x = feature(F.col("word"))
    return words.select("id", x.alias("x")).withColumn("x_hat", F.col("x"))


def title_set(titles: DataFrame, width: int, feature: Callable[[Column], Column], drop: int = 0, swap: int = 0, seed: int = 1, rows: int = tx.SENTENCE) -> DataFrame:
    """(id, x, x_hat) of titles (id, tokens), in an order given by the seed.

    `swap` rows of both change places, then `drop` rows of x alone become zero; the picks depend on the seed and the id.
    """
    key = F.concat_ws(":", F.lit(seed), F.col("id"))
    cells = titles.select("id", ft.matrix(F.col("tokens"), width, rows, feature).alias("x_hat"))
    if swap:
        cells = cells.withColumn("x_hat", ft.swap_rows(F.col("x_hat"), width, swap, key, rows))
    x = ft.drop_rows(F.col("x_hat"), width, drop, key, rows) if drop else F.col("x_hat")
    return cells.select("id", x.alias("x"), "x_hat").orderBy(F.xxhash64(F.lit(seed), "id"))


def resolve(name: str | None, spark: SparkSession, posts: DataFrame | None = None, drop: int = 0, swap: int = 0) -> DataFrame:
    """A training set by name: example (the default; a made-up word for each post, or 1,000), partial (body words), or titles."""
    if name in (None, "example"):
        return word_set(synthetic_words(spark.range(1000) if posts is None else posts.select("id")))
    if name == "partial":
        return word_set(body_words(posts).select("id", "word"))
    if name == "titles":
        titles = posts.select("id", tx.words_array(F.col("title")).alias("tokens")).where(F.size("tokens") > 0)
        return title_set(titles, 32, lambda w: ft.binarized(ft.histogram(w)), drop, swap)
    raise NotImplementedError(f"no data set {name!r}")
