"""Embedding near-dedup by PCA-ordered tiled comparison.

Unit vectors are rotated onto the principal axes of the corpus, so leading coordinates hold most of a
product. Vectors are dealt to groups by range of the first coordinate and packed into tiles. Two groups,
then two tiles, are skipped when the boxes of their leading coordinates and the range of their suffix
norms show that no pair can reach the threshold. Otherwise leading dimensions are multiplied first; the
rest of a product is at most the product of the suffix norms, and a tile, row, column or pair stops as
soon as its bound falls below the threshold.

Plan: equal vectors become one node with a count before anything is compared. Each pair of groups is one
task that reads two groups of GROUP numbers at most and returns a count of links per node and a spanning
forest of the links - never the pairs. A vector is sent to as many tasks as its group has partners. While
GROUPS groups hold all vectors, what is sent grows with the vectors; beyond, with the pairs of groups that
bounds can't tell apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table
from .components import Forest, components

THRESHOLD = 0.9
#: Vectors of a tile; numbers in a group's vectors at most; groups at least, if there is a tile for each.
TILE, GROUP, GROUPS = 512, 1 << 22, 8
#: Leading coordinates that make the boxes of tiles and groups, and coordinates multiplied at a time.
BOX, STEP = 8, 16
#: Room for rounding in bounds; pairs this near the threshold are computed again from the vectors themselves.
ROOM = 1e-9


def _moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column(0))
            x /= np.linalg.norm(x, axis=1)[:, None]
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = values.reshape(len(column), -1)
    scale = np.frexp(np.abs(x).max(axis=1))[1]  # to powers of two, exactly, so that no finite vector's norm overflows or vanishes
    return np.ldexp(x, -scale[:, None])


def axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Principal axes of the unit vectors as columns, largest first; dim * dim numbers reach the driver."""
    rows = vectors.select("vector").mapInArrow(_moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((dim, dim))
    for r in rows:
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
    return np.linalg.eigh(m)[1][:, ::-1]


def _lead(basis: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                lead = (x / np.linalg.norm(x, axis=1)[:, None]) @ basis[:, 0]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lead)], names=["node", "vector", "copies", "lead"])

    return run


def _boxes(z: np.ndarray) -> np.ndarray:
    """Lowest and highest leading coordinates and suffix norms."""
    lead = np.column_stack((z[:, :BOX], np.linalg.norm(z[:, BOX:], axis=1)))
    return np.stack((lead.min(axis=0), lead.max(axis=0)))


def apart(a: np.ndarray, b: np.ndarray) -> float:
    """Least squared distance of two vectors with these boxes; for unit vectors cosine = 1 - that / 2."""
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float(gap @ gap)


def _pack(basis: np.ndarray):
    names = ["part", "tile", "nodes", "copies", "matrix", "box"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, k, group, single = [], 0, None, False

        def tile(part: list) -> pa.RecordBatch:
            nodes, copies, x = (np.concatenate([p[i] for p in part]) for i in range(3))
            z = (x / np.linalg.norm(x, axis=1)[:, None]) @ basis
            values = [group], [k], [nodes.astype("<i8").tobytes()], [copies.astype("<i8").tobytes()], [x.astype("<f4" if single else "<f8").tobytes()], [_boxes(z).ravel().tolist()]
            kinds = pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            group, single = b.column(3)[0].as_py(), pa.types.is_float32(b.column(1).type.value_type)
            for i in range(0, b.num_rows, TILE):
                part = b.slice(i, TILE)
                held.append((part.column(0).to_numpy(), part.column(2).to_numpy(), _matrix(part.column(1))))
                if sum(len(h[0]) for h in held) >= TILE:
                    yield tile(held)
                    held, k = [], k + 1
        if held:
            yield tile(held)

    return run


def near_pairs(a: np.ndarray, b: np.ndarray, threshold: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) and cosines of pairs of rows that reach the threshold less ROOM; rows are rotated unit vectors.

    Whole tiles are multiplied while many pairs are open, single pairs once few are.
    """
    dim, least = a.shape[1], threshold - ROOM
    rows, columns = np.arange(len(a)), np.arange(len(b))
    sums = np.zeros((len(a), len(b)))
    i = j = None
    for at in range(0, dim, step):
        end = min(at + step, dim)
        left, right = np.linalg.norm(a[:, end:], axis=1), np.linalg.norm(b[:, end:], axis=1)
        if i is None:
            sums += a[rows, at:end] @ b[columns, at:end].T
            open_ = sums + np.outer(left[rows], right[columns]) >= least
            n = np.count_nonzero(open_)
            if not n:
                break
            if n < 0.02 * open_.size:
                r, c = np.nonzero(open_)
                i, j, found = rows[r], columns[c], sums[r, c]
            else:
                some, any_ = open_.any(axis=1), open_.any(axis=0)
                rows, columns, sums = rows[some], columns[any_], sums[some][:, any_]
        else:
            found = found + np.einsum("ij,ij->i", a[i, at:end], b[j, at:end])
            keep = found + left[i] * right[j] >= least
            i, j, found = i[keep], j[keep], found[keep]
    else:
        if i is None:
            r, c = np.nonzero(sums >= least)
            return rows[r], columns[c], sums[r, c]
        return i, j, found
    return np.empty(0, int), np.empty(0, int), np.empty(0)


def _compare(basis: np.ndarray, threshold: float):
    reach = 2 - 2 * threshold + ROOM

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        g, h = (k.as_py() for k in key)
        tiles: dict = {g: [], h: []}
        for r in rows.select(["group", "nodes", "matrix", "box", "copies"]).to_pylist():
            nodes = np.frombuffer(r["nodes"], "<i8")
            x = np.frombuffer(r["matrix"], f"<f{len(r['matrix']) // (len(nodes) * len(basis))}").astype(float).reshape(len(nodes), -1)
            unit = x / np.linalg.norm(x, axis=1)[:, None]
            tiles[r["group"]].append((nodes, np.frombuffer(r["copies"], "<i8"), x, unit @ basis, np.array(r["box"]).reshape(2, -1)))
        places: dict = {}
        at = 0
        for k in tiles:
            for t, tile in enumerate(tiles[k]):
                places[k, t] = at
                at += len(tile[0])
        every = np.concatenate([t[0] for k in tiles for t in tiles[k]])
        links, forest = np.zeros(at, np.int64), Forest(at)
        for s, (_, copies, x, z, box) in enumerate(tiles[g]):
            for t, (_, copies_b, y, w, box_b) in enumerate(tiles[h]):
                if g == h and t < s or apart(box, box_b) > reach:
                    continue
                i, j, cosine = near_pairs(z, w, threshold)
                close = np.abs(cosine - threshold) <= ROOM
                if close.any():
                    p, q = x[i[close]], y[j[close]]
                    cosine[close] = np.einsum("ij,ij->i", p, q) / np.sqrt(np.einsum("ij,ij->i", p, p) * np.einsum("ij,ij->i", q, q))
                keep = cosine >= threshold
                i, j = i[keep], j[keep]
                if g == h and s == t:
                    other = i < j
                    i, j = i[other], j[other]
                a, b = i + places[g, s], j + places[h, t]
                np.add.at(links, a, copies_b[j])
                np.add.at(links, b, copies[i])
                forest.join(a, b)
        some = np.flatnonzero(links)
        a, b = forest.links()
        ends = np.concatenate((np.full(len(some), -1), every[b]))
        return pa.table({"a": np.concatenate((every[some], every[a])), "b": pa.array(ends, pa.int64()), "n": np.concatenate((links[some], np.zeros(len(a), np.int64)))})

    return run


def _partners(numbers: np.ndarray, boxes: np.ndarray, reach: float):
    """(of, g, h): the pairs g <= h of groups that a group is part of, if their boxes are near enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g in b.column(0).to_pylist():
                own = boxes[np.searchsorted(numbers, g)]
                gap = np.maximum(0, np.maximum(own[0] - boxes[:, 1], boxes[:, 0] - own[1]))
                h = numbers[(gap**2).sum(axis=1) <= reach]
                kinds = [pa.array(v, pa.int32()) for v in (np.full(len(h), g), np.minimum(g, h), np.maximum(g, h))]
                yield pa.RecordBatch.from_arrays(kinds, names=["of", "g", "h"])

    return run


def _links(nodes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(a, b, n): links a-b of a spanning forest (n = 0), or n links that node a has (b = -1)."""
    basis = axes(nodes, dim)
    n = nodes.count()
    groups = max(1, min(GROUPS, n // TILE), math.ceil(n * dim / GROUP))
    kind = nodes.schema["vector"].dataType.simpleString()
    lead = stored(nodes.select("node", "vector", "copies").mapInArrow(_lead(basis), f"node long, vector {kind}, copies long, lead double"), "pca-lead")
    dealt = lead.repartitionByRange(groups, "lead", "node").sortWithinPartitions("lead", "node")
    tiles = dealt.select("node", "vector", "copies", F.spark_partition_id().alias("part")).mapInArrow(_pack(basis), "part int, tile int, nodes binary, copies binary, matrix binary, box array<double>")
    tiles = stored(tiles, "pca-tiles")
    dealt_to = (tiles.agg(F.max("part")).first()[0] or 0) + 1  # a group is a run of partitions, however many there are
    tiles = tiles.withColumn("group", F.floor(F.col("part") * F.lit(groups) / F.lit(dealt_to)).cast("int"))
    bounds = tiles.select("group", F.posexplode("box").alias("i", "v")).groupBy("group", "i").agg(F.min("v").alias("low"), F.max("v").alias("high")).orderBy("group", "i").collect()
    numbers = np.array(sorted({r["group"] for r in bounds}))
    values = np.array([(r["low"], r["high"]) for r in bounds]).reshape(len(numbers), -1, 2)
    half = min(BOX, dim) + 1
    boxes = np.stack((values[:, :half, 0], values[:, half:, 1]), axis=1)  # a box for each group of GROUP numbers
    some = tiles.select("group").distinct().repartition("group")
    partners = some.mapInArrow(_partners(numbers, boxes, 2 - 2 * threshold + ROOM), "of int, g int, h int")
    sent = tiles.join(partners, F.col("group") == F.col("of"))
    return sent.groupBy("g", "h").applyInArrow(_compare(basis, threshold), "a long, b long, n long")


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vectors with n_links, component_id and kept; two vectors link when their cosine is threshold or more.

    n_links counts other rows, so copies of a vector link with each other. Vectors that are null, empty or zero, or
    hold a null or non-finite component, link with nothing and are their own component; vectors of different lengths
    do not link. component_id is the smallest id that links reach, null ids aside; kept says that a row has that id
    (a row with a null id is kept if its component has no other). Columns of vectors with the added names are
    replaced. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    added = ("n_links", "component_id", "kept")
    own = [c for c in vectors.columns if c.lower() not in added]
    v = F.col("vector")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.struct(*own).alias("row"), F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).withColumn("fit", fit)
    same = rows.where("fit").groupBy("vector").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(same.withColumn("node", F.monotonically_increasing_id()), "pca-nodes")
    found = None
    for r in nodes.select(F.size("vector").alias("dim")).distinct().collect():
        part = _links(nodes.where(F.size("vector") == r["dim"]), r["dim"], threshold)
        found = part if found is None else found.union(part)
    found = stored(found if found is not None else spark.createDataFrame([], "a long, b long, n long"), "pca-links")
    labels = components(found.where("b >= 0").select("a", "b"), "pca-components")
    counts = found.where("b < 0").groupBy("a").agg(F.sum("n").alias("n"))
    named = nodes.join(labels.withColumnRenamed("node", "l"), F.col("node") == F.col("l"), "left").join(counts, F.col("node") == F.col("a"), "left")
    named = named.select(F.col("vector").alias("of"), "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "node").alias("label"))
    named = stored(named, "pca-named")
    names = stored(named.groupBy("label").agg(F.min("least").alias("component_id")), "pca-names")
    classes = stored(named.join(names, "label").select("of", "n_links", "component_id"), "pca-classes")
    linked = rows.where("fit").join(classes, F.col("vector") == F.col("of"))
    alone = rows.where("not fit").select("row", "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.select("row", "id", "n_links", "component_id").unionByName(alone)
    return out.select("row.*", "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def pca_query(spark, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")


PCA_SQL = """
with recursive v as (
    select vec_id, embedding::DOUBLE[] as e from embeddings
    where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and list_max(list_transform(embedding, lambda x: abs(x))) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_cosine_similarity(a.e, b.e) >= 0.9),
r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
n as (select a, count(*) as n from l group by a),
m as (select a, min(b) as least from r group by a)
select vec_id, coalesce(n, 0) as n_links, coalesce(least(least, vec_id), vec_id) as component_id,
       coalesce(least(least, vec_id), vec_id) = vec_id as kept
from embeddings left join n on n.a = vec_id left join m on m.a = vec_id
"""
