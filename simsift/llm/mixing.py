"""Mixing sources to target weights by entropy balancing.

Among all document rates r_d in [0, cap] that give every source its target number of words, the one
closest to "every document once" minimises sum(r_d log r_d - r_d). The Lagrange dual has one multiplier
per source and r_d = min(cap, exp(lambda_source * c_d)), where c_d is the document's size over the
source's typical size: an exponential tilt. As a document has one source, the Hessian of the dual is
diagonal: a Newton step of a source needs that source's sums only. Each iteration is one aggregate over
the counts of sizes by source, for all sources at once; multipliers and brackets are a table with a row
for each source. The counts have a row for each size that occurs, however many documents there are; a
source with a third of all rows has no more than the longest text allows.

Rates are rounded into whole copies by error diffusion from the largest size to the smallest, so what a
large document takes too much or too little, smaller ones give back. Which documents of a size get the
odd copies is decided by a hash of their id, in sub-groups so that no size has to fit in one task.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table, temporary

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: The mix holds this share of all words, and no source more than CAP times its own.
SHARE, CAP = 1.5, 2.0
#: Sub-groups of the documents of one source and size at least; there are more where a sub-group could exceed SUB rows.
SPREAD, SUB = 64, 100_000
#: Newton iterations at most (a bracket halves where a step leaves it), and the relative error that ends them.
ROUNDS, EXACT = 200, 1e-10
#: Sources that one task puts in order.
ORDERED = 1_000_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """totals (source, source_size) with the target of each source.

    Sources by code point, null last, take the weights in turn. Targets are shares by weight of
    share * all words; what a source would get beyond cap times its size goes to the others by weight,
    until none is above. Each round is one aggregate over the sources; nothing but sums leaves it.
    """
    n = max(1, math.ceil(totals.count() / ORDERED))
    ranged = stored(totals.repartitionByRange(n, F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "mix-sources")
    before, starts = 0, []
    for part, count in sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect()):
        starts.append((part, before))
        before += count
    ranged = ranged.join(totals.sparkSession.createDataFrame(starts, "part int, offset long"), "part")
    place = F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int") + 1)
    ranked = ranged.withColumn("weight", weight)
    limit = F.col("source_size") * F.lit(float(cap))
    first = ranked.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    level, above = share * (first["words"] or 0) / (first["weight"] or 1.0), -1
    while True:
        full = F.col("weight") * F.lit(level) > limit
        now = ranked.agg(
            F.sum(F.when(full, limit)).alias("given"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count(F.when(full, 1)).alias("above")
        ).first()
        if now["above"] == above or not now["weight"]:
            break
        above, level = now["above"], (share * first["words"] - (now["given"] or 0.0)) / now["weight"]
    return ranked.select("source", "source_size", F.least(F.col("weight") * F.lit(level), limit).alias("target"))


def _tilted(lam: Column, size: Column, mean: Column, cap: float) -> Column:
    return F.exp(F.least(lam * size / mean, F.lit(math.log(cap))))


def tilt(sizes: DataFrame, cap: float = CAP) -> DataFrame:
    """sizes (source, size, n, target, ...) with rate = min(cap, exp(lam * c)), such that the words of each source come to target.

    Newton's method on the derivative of the dual, which grows with lam; a bracket holds every step.
    """
    words = F.col("size") * F.col("n")
    facts = sizes.groupBy("source").agg(F.sum(words).cast("double").alias("total"), F.sum(F.col("size") * words.cast("double")).alias("squares"), F.first("target").alias("goal"))
    facts = facts.select(F.col("source").alias("of"), "goal", F.try_divide("squares", "total").alias("mean"), (F.col("goal") <= 0).alias("none"), (F.col("goal") >= cap * F.col("total")).alias("all"))
    infinity = float("inf")
    start = facts.select("*", F.lit(0.0).alias("lam"), F.lit(-infinity).alias("low"), F.lit(infinity).alias("high"), (F.col("mean").isNull() | F.col("none") | F.col("all")).alias("done"))
    state = stored(start, "mix-dual")
    for _ in range(ROUNDS):
        if state.where("not done").isEmpty():
            break
        with temporary(sizes.sparkSession) as kept:
            now = sizes.join(state.where("not done"), F.col("source").eqNullSafe(F.col("of")))
            rate, c = _tilted(F.col("lam"), F.col("size"), F.col("mean"), cap), F.col("size") / F.col("mean")
            free = F.col("lam") * c < math.log(cap)
            sums = now.groupBy(F.col("source").alias("s")).agg(F.sum(words * rate).alias("words"), F.sum(F.when(free, words * rate * c)).alias("slope"))
            over = F.col("words") - F.col("goal")
            low, high = F.when(over > 0, F.col("low")).otherwise(F.col("lam")), F.when(over > 0, F.col("lam")).otherwise(F.col("high"))
            newton = F.col("lam") - over / F.nullif(F.col("slope"), F.lit(0.0))
            far = F.when((low > -infinity) & (high < infinity), (low + high) / 2).when(over > 0, 2 * F.col("lam") - 1).otherwise(2 * F.col("lam") + 1)
            step = F.when((newton > low) & (newton < high), newton).otherwise(far)
            ended = F.abs(over) <= EXACT * F.col("goal")
            moved = state.where("not done").join(sums, F.col("of").eqNullSafe(F.col("s")))
            moved = moved.select("of", "goal", "mean", "none", "all", F.when(ended, F.col("lam")).otherwise(step).alias("lam"), low.alias("low"), high.alias("high"), ended.alias("done"))
            state = kept(state.where("done").unionByName(moved), "mix-dual")
    rate = F.when(F.col("none") | F.col("mean").isNull(), 0.0).when(F.col("all"), float(cap)).otherwise(_tilted(F.col("lam"), F.col("size"), F.col("mean"), cap))
    return sizes.join(state, F.col("source").eqNullSafe(F.col("of"))).select(*sizes.columns, rate.alias("rate"))


def diffuse(size: list[int], n: list[int], rate: list[float], cap: float = CAP) -> list[int]:
    """Whole copies of all documents of each size, sizes in descending order; the error moves on to smaller ones."""
    out, carry = [], 0.0
    for s, k, r in zip(size, n, rate, strict=True):
        if s > 0:
            want = s * k * r + carry
            out.append(min(max(round(want / s), 0), math.floor(cap) * k))
            carry = want - out[-1] * s
        else:
            out.append(k)
    return out


def _diffused(cap: float):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False)
        return rows.assign(copies_all=diffuse(rows["size"].tolist(), rows["n"].tolist(), rows["rate"].tolist(), cap))

    return solve


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """docs with size, source_size, target, rate and copies (whole numbers, cap at most).

    Columns of docs with these names are replaced. Null texts have size 0 and, like empty ones, stay once
    (they take no words). A null source is a source of its own, the last. Equal ids are told apart by a
    hash of their text; fully equal rows may swap their copies. An empty table gives an empty result.
    Reruns on the same rows agree.
    """
    added = ["size", "source_size", "target", "rate", "copies"]
    own = [c for c in docs.columns if c.lower() not in added]
    order = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.select(
        F.struct(*own).alias("row"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), order.alias("order")
    )
    rows = rows.withColumn("sub", F.pmod("order", F.lit(max(SPREAD, math.ceil(docs.count() / SUB)))).cast("int"))
    counts = stored(rows.groupBy("source", "size", "sub").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    sizes = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = stored(source_targets(totals, weights, share, cap), "mix-targets")
    known = sizes.alias("z").join(targets.alias("t"), F.col("z.source").eqNullSafe(F.col("t.source"))).select("z.source", "size", "n", "source_size", "target")
    known = tilt(stored(known, "mix-known"), float(cap))
    plan = known.groupBy("source").applyInPandas(
        _diffused(float(cap)), f"source {dict(docs.dtypes)[source_col]}, size long, n long, source_size long, target double, rate double, copies_all long"
    )
    plan = stored(plan, "mix-plan")
    ahead = F.sum("n").over(Window.partitionBy("source", "size").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1))
    subs = counts.withColumn("ahead", F.coalesce(ahead, F.lit(0))).drop("n")
    subs = subs.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.size") == F.col("p.size")))
    subs = subs.select("s.source", "s.size", "sub", "ahead", "n", "source_size", "target", "rate", "copies_all")
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("source", "size", "sub").orderBy("order")))
    both = ranked.alias("r").join(
        subs.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.size") == F.col("s.size")) & (F.col("r.sub") == F.col("s.sub"))
    )
    extra = (F.col("ahead") + F.col("place") <= F.col("copies_all") % F.col("n")).cast("int")
    copies = (F.floor(F.col("copies_all") / F.col("n")) + extra).cast("int")
    return both.select("row.*", "r.size", "source_size", "target", "rate", copies.alias("copies"))


def mix_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "rate")
