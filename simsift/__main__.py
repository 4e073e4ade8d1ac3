"""Command line: index posts, search, compare hashes, train an encoder, export vectors.

    python -m simsift index posts.xml index/ --hash sha1
    python -m simsift search index/ "how to store a connection string"
    python -m simsift compare posts.xml --hashes sha1 sha3 xxh32
    python -m simsift train posts.xml model/ --model cnn
    python -m simsift encode posts.xml model/ codes/
    python -m simsift lookup codes/ model/ "how to store a connection string"
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import features as ft
from .functions import text as tx
from .operators import encode as enc
from .operators import evaluate as ev
from .operators import training
from .operators.minhash import MinHash, MinHashIndex
from .operators.prefix import PrefixIndex
from .session import stored
from .sources import posts, sinks

WIDTH = 32


def titles(spark: SparkSession, path: str, lo: int, hi: int) -> DataFrame:
    """(id, tokens) of the posts of a range; bodies are not read."""
    found = posts.posts_in_range(posts.read_posts(spark, path), lo, hi, "file", "place")
    return posts.title_tokens(found.withColumn("title", tx.clean_string(F.col("title"))))


def matrices(items: DataFrame) -> DataFrame:
    return stored(items.select("id", ft.matrix(F.col("tokens"), WIDTH, tx.SENTENCE, lambda w: ft.binarized(ft.histogram(w))).alias("x")), "matrices")


def query(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("query", text)], "id string, text string").select("id", tx.clean_query(F.col("text")).alias("tokens"))


def bits(codes: DataFrame) -> DataFrame:
    return codes.select("id", F.transform("code", lambda v: F.when(v > 0.5, 1).otherwise(0)).alias("vec"))


def main(args: list[str] | None = None) -> None:
    cfg = Config()
    parser = argparse.ArgumentParser(prog="simsift", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["index", "search", "compare", "train", "encode", "lookup"])
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--hash", default="sha1")
    parser.add_argument("--hashes", nargs="*", default=["sha1", "sha3", "xxh32"])
    parser.add_argument("--range", nargs=2, type=int, default=cfg.parse_range)
    parser.add_argument("--limit", type=int, default=cfg.result_limit)
    parser.add_argument("--threshold", type=float, default=cfg.threshold)
    parser.add_argument("--model", default=cfg.model_type.lower())
    parser.add_argument("--latent", type=int, default=cfg.latent)
    parser.add_argument("--epochs", type=int, default=5)
    parser.add_argument("--batch", type=int, default=training.BATCH)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("simsift").getOrCreate()

    if a.command == "index":
        MinHashIndex.build(titles(spark, a.paths[0], *a.range), MinHash(cfg.num_perm, a.threshold, a.hash)).save(a.paths[1])
    elif a.command == "search":
        MinHashIndex.load(spark, a.paths[0]).search(query(spark, a.paths[1]), a.limit).orderBy("place").show(a.limit, False)
    elif a.command == "compare":
        items = stored(titles(spark, a.paths[0], *a.range), "titles")
        indexes = {h: ev.make_index(items, h, a.threshold) for h in a.hashes} | {"whole": ev.make_index(items, whole=True)}
        names = list(indexes)
        ev.recall(ev.hits(ev.compare(items, indexes, limit=a.limit), names), names).show(truncate=False)
    elif a.command == "train":
        net = enc.Autoencoder(a.model, WIDTH, a.latent, last=cfg.last_activation)
        rows = stored(matrices(titles(spark, a.paths[0], *a.range)), "matrices")

        def each(epoch: int, losses: list) -> None:
            sinks.append_metrics(spark.createDataFrame(losses, "epoch int, name string, value double"), f"{a.paths[1]}/metrics")

        training.fit(
            rows, net, a.epochs, a.batch, tx.SENTENCE, cfg.learning_rate, cfg.l1, cfg.l2, cfg.max_drop, cfg.max_swap, cfg.adversarial, cfg.latent_weight, f"{a.paths[1]}/weights", cfg.checkpoints_kept, each
        )
    elif a.command == "encode":
        net = enc.Autoencoder.load(spark, f"{a.paths[1]}/weights")
        items = titles(spark, a.paths[0], *a.range)
        codes = stored(enc.encode(matrices(items), net.encode), "codes")
        PrefixIndex.build(bits(codes), net.settings["latent"], a.limit).save(f"{a.paths[2]}/index")
        shown = codes.join(items, "id")
        sinks.write_projector(shown, f"{a.paths[2]}/projector", F.col("code"), F.col("id").alias("ID"), F.array_join("tokens", " ").alias("Title"))
    else:
        net = enc.Autoencoder.load(spark, f"{a.paths[1]}/weights")
        codes = enc.encode(matrices(query(spark, a.paths[2])), net.encode)
        index = PrefixIndex.load(spark, f"{a.paths[0]}/index")
        index.search(stored(bits(codes), "query"), a.limit).orderBy("place").show(a.limit, False)


if __name__ == "__main__":
    main()
