"""Exact Jaccard joins and searches over sets of words, by a prefix filter.

Equal sets are one class, named by its smallest id; pairs are between classes, members come with them. With words in
order of rarity, two sets of similarity t share two of their first size - ceil(t * size) + 2 words (or one, if one common
word is enough for sets of their sizes), so only pairs of these are joined, and only where the sizes and the places of the
words allow t. Two words that lead very many sets are dealt in tiles (`tiled`): cells of bounded size meet in pairs, so
that no task takes a whole key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import bind
from ..session import stored

#: Rows of a key that one task takes from either side.
TILE = 2000


def _tiles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tiles): keys with more than TILE rows, and how many tiles they are dealt to."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE)
    return sizes.select(*keys, F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))


def _dealt(rows: DataFrame, tiles: DataFrame, keys: list[str], by: Column) -> DataFrame:
    out = rows.join(tiles, keys, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    return out.withColumn("tile", F.pmod(F.xxhash64(by), "tiles").cast("int"))


def tiled_pairs(rows: DataFrame, keys: list[str], id_col: str, near: Callable[..., Column] | None = None, with_: tuple[str, ...] = ()) -> DataFrame:
    """(a, b), a < b: distinct pairs of ids that have a key in common; `near`, given the columns `with_` of one side and
    then of the other, says which to take."""
    dealt = _dealt(rows, stored(_tiles(rows, keys), "tiles"), keys, F.col(id_col))
    left = dealt.select(*keys, *[F.col(c).alias(f"a_{c}") for c in with_], F.col(id_col).alias("a"), F.col("tile").alias("i"), F.explode(F.expr("sequence(tile, tiles - 1)")).alias("j"))
    right = dealt.select(*keys, *[F.col(c).alias(f"b_{c}") for c in with_], F.col(id_col).alias("b"), F.col("tile").alias("j"), F.explode(F.expr("sequence(0, tile)")).alias("i"))
    pairs = left.join(right, [*keys, "i", "j"]).where("i < j or a < b").where("a <> b")
    pairs = pairs if near is None else pairs.where(near(*[F.col(f"{side}_{c}") for side in "ab" for c in with_]))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def tiled_join(asked: DataFrame, rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """asked joined to rows by keys; rows of a frequent key are dealt to tiles by their id, what asks for it goes to each."""
    tiles = stored(_tiles(rows, keys), "tiles")
    dealt = _dealt(rows, tiles, keys, F.col(id_col)).drop("tiles")
    to = asked.join(tiles, keys, "left").withColumn("tile", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1))).drop("tiles")
    return to.join(dealt, [*keys, "tile"]).drop("tile")


def set_classes(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (id, class) of items (id, tokens), and classes (class, tokens): distinct sets of words, in order."""
    sets = items.where(F.size("tokens") > 0).select("id", F.array_sort(F.array_distinct("tokens")).alias("tokens"))
    sets = stored(sets, "sets")
    classes = stored(sets.groupBy("tokens").agg(F.min("id").alias("class")), "set-classes")
    return stored(sets.join(classes, "tokens").select("id", "class"), "set-members"), classes


def _ranked(classes: DataFrame, rarity: DataFrame) -> DataFrame:
    """classes with their words in order of rarity; words that rarity doesn't know come first."""
    words = classes.select("class", F.explode("tokens").alias("word")).join(rarity, "word", "left")
    ranked = words.groupBy("class").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("r"))
    return stored(ranked.select("class", F.transform("r", lambda r: r["word"]).alias("tokens")), "ranked-sets")


def _keyed(ranked: DataFrame, threshold: float) -> DataFrame:
    """(class, size, key, at): two words of a set's first ones, by a hash, and the place of the second; single words, with
    place -1, of sets so small that one common word can be enough."""
    size = F.size("tokens")
    lead = F.slice("tokens", F.lit(1), size - F.ceil(size * threshold - 1e-9).cast("int") + 2)
    two = lambda ws: F.flatten(F.transform(ws, lambda w, j: F.transform(F.slice(ws, F.lit(1), j), lambda v: F.struct(F.xxhash64(v, w).alias("key"), j.alias("at")))))
    one = F.transform("tokens", lambda w: F.struct(F.xxhash64(w).alias("key"), F.lit(-1).alias("at")))
    every = F.when(size <= (1 + threshold) / threshold + 1e-9, F.concat(bind(lead, two), one)).otherwise(bind(lead, two))
    return ranked.select("class", size.alias("size"), F.explode(every).alias("k")).select("class", "size", "k.key", "k.at")


def _may_reach(threshold: float) -> Callable[..., Column]:
    """Two sets of these sizes whose first two common words end at these places can reach the threshold."""

    def near(n: Column, i: Column, m: Column, j: Column) -> Column:
        enough = 2 + F.least(n - i, m - j) - 1 >= (n + m) * (threshold / (1 + threshold)) - 1e-9
        return (n >= m * threshold - 1e-9) & (m >= n * threshold - 1e-9) & enough

    return near


def _similarity(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def jaccard_pairs(items: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """pairs (a, b, similarity), a < b, of classes of different sets of items (id, tokens) that reach the threshold, and
    members (id, class). Items without tokens are in neither."""
    members, classes = set_classes(items)
    rarity = classes.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = _ranked(classes, rarity)
    pairs = tiled_pairs(_keyed(ranked, threshold), ["key"], "class", _may_reach(threshold), ("size", "at"))
    both = pairs.join(ranked.toDF("a", "ta"), "a").join(ranked.toDF("b", "tb"), "b")
    found = both.select("a", "b", _similarity(F.col("ta"), F.col("tb")).alias("similarity"))
    return found.where(F.col("similarity") >= threshold), members


def jaccard_topk(items: DataFrame, queries: DataFrame, threshold: float = 0.5, limit: int = 10) -> DataFrame:
    """(query, id, similarity, place): for each of queries (id, tokens) the `limit` most similar of items (id, tokens)
    that reach the threshold, ties by id. Exact. Queries without tokens find nothing."""
    members, classes = set_classes(items)
    asked, kinds = set_classes(queries)
    rarity = stored(classes.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "rarity")
    mine, other = _ranked(classes, rarity), _ranked(kinds, rarity)
    ask = _keyed(other, threshold).select(F.col("class").alias("q"), F.col("size").alias("m"), F.col("at").alias("to"), "key")
    pairs = tiled_join(ask, _keyed(mine, threshold), ["key"], "class").where(_may_reach(threshold)(F.col("size"), F.col("at"), F.col("m"), F.col("to")))
    pairs = pairs.select("q", "class").distinct()
    both = pairs.join(other.toDF("q", "tq"), "q").join(mine, "class").select("q", "class", _similarity(F.col("tq"), F.col("tokens")).alias("similarity")).where(F.col("similarity") >= threshold)
    first = members.withColumn("k", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("k") <= limit).select("class", "id")
    by_rank = Window.partitionBy("q").orderBy(F.desc("similarity"), "id")
    best = both.join(first, "class").withColumn("place", F.row_number().over(by_rank)).where(F.col("place") <= limit)
    return asked.select(F.col("id").alias("query"), F.col("class").alias("q")).join(best.select("q", "id", "similarity", "place"), "q").drop("q")
