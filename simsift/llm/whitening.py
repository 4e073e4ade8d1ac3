"""Embedding whitening from an exact integer scatter.

Entries become whole numbers. A task subtracts a shift, and adds up sums and cross-products of what is left without
any rounding: numbers are cut into limbs of 20 bits, blocks of rows are short enough for a product of limbs to stay
below 2^53, and the blocks' products are kept as integers of any size. Tasks return them in limbs of 30 bits, which
Spark adds up as longs with map-side combining; only dim^2 numbers reach the driver. There n*X'X - S*S' is formed in
integers, divided once, and decomposed by eigh. A second pass over the rows projects them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Bits of a limb in a product, rows of a block (2 * LIMB + log2(ROWS) <= 53), and bits of a limb that Spark adds up.
LIMB, ROWS, SENT = 20, 2048, 30
#: Whole numbers saturate here, so that differences of two fit a long.
MOST = 1 << 61
ADDED = ("n", "deviation", "deviation_text", "whitened", "explained", "identity_error")


def integers(column: pa.Array, scale: int = SCALE, offset: int = OFFSET) -> np.ndarray:
    """floor(scale * c) + offset of every entry, rows of one length; beyond +-MOST it saturates."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(scale * values), -MOST, MOST).astype(np.int64)
    return np.clip(whole + offset, -MOST, MOST)


def limbs(y: np.ndarray, bits: int = LIMB) -> list[np.ndarray]:
    """Signed limbs as doubles, lowest first: y = sum of limb k times 2^(bits * k)."""
    sign, size, out = np.sign(y), np.abs(y), []
    while not out or size.any():
        out.append((sign * (size & ((1 << bits) - 1))).astype(np.float64))
        size = size >> bits
    return out


def cross(y: np.ndarray) -> np.ndarray:
    """y'y of whole numbers as an array of Python integers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), ROWS):
        parts = limbs(y[at : at + ROWS])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[: i + 1]):
                product = (a.T @ b).astype(np.int64)  # every sum in it is a whole number below 2^53
                total = total + ((product if i == j else product + product.T).astype(object) << LIMB * (i + j))
    return total


def _sent(value: int) -> Iterator[tuple[int, int]]:
    sign, size, k = (-1 if value < 0 else 1), abs(value), 0
    while size:
        yield k, sign * (size & ((1 << SENT) - 1))
        size, k = size >> SENT, k + 1


def _moments(shift: np.ndarray, scale: int, offset: int):
    """(i, j, limb, v): products of dimensions i <= j, sums as i = -1, and the number of rows as i = j = -1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(len(shift), object), np.zeros((len(shift), len(shift)), object)
        for b in batches:
            if b.num_rows:
                y = integers(b.column(0), scale, offset) - shift
                n += len(y)
                products = products + cross(y)
                for part, limb in enumerate(limbs(y)):  # below 2^20 times the rows of a batch
                    sums = sums + (limb.astype(np.int64).sum(axis=0).astype(object) << LIMB * part)
        if not n:
            return
        found = [(-1, -1, k, v) for k, v in _sent(n)]
        for i in range(len(shift)):
            found += [(-1, i, k, v) for k, v in _sent(sums[i])]
            found += [(i, j, k, v) for j in range(i, len(shift)) for k, v in _sent(products[i, j])]
        kinds = pa.int32(), pa.int32(), pa.int32(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["i", "j", "limb", "v"])

    return run


@dataclass
class Moments:
    """Exact moments of whole-number vectors less a shift: n rows, sums, and scatter n*Y'Y - S*S' (which no shift changes)."""

    n: int
    shift: np.ndarray
    sums: np.ndarray
    scatter: np.ndarray

    def components(self, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Eigenvalues and unit eigenvectors (columns) of the covariance by falling eigenvalue, and shares of the trace.
        The entry of a vector that is largest in size is positive."""
        square = self.n * self.n
        covariance = np.array([[a / square for a in row] for row in self.scatter], float)  # each one division of two integers
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1][:top], vectors[:, ::-1][:, :top]
        most = np.abs(vectors).argmax(axis=0)
        vectors = vectors * np.where(vectors[most, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
        trace = sum(self.scatter.diagonal()) / square
        return values, vectors, values / trace if trace else np.full(len(values), np.nan)


def exact_moments(vectors: DataFrame, column: str, dim: int, scale: int = SCALE, offset: int = OFFSET) -> Moments:
    """Moments of floor(scale * c) + offset over all rows; the column's vectors are valid and have dim entries each."""
    one = vectors.select(column).first()[0]
    shift = integers(pa.array([one], pa.list_(pa.float64())), scale, offset)[0]  # any row serves; it keeps numbers small
    rows = vectors.select(column).mapInArrow(_moments(shift, scale, offset), "i int, j int, limb int, v long").groupBy("i", "j", "limb").agg(F.sum("v").alias("v")).collect()
    n, sums, products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
    for i, j, limb, v in rows:
        value = v << SENT * limb
        if j < 0:
            n += value
        elif i < 0:
            sums[j] += value
        else:
            products[i, j] += value
            if i != j:
                products[j, i] += value
    return Moments(n, shift, sums, n * products - np.outer(sums, sums))


def deviations(y: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Sum over dimensions of (n * y - sums)^2 of every row, exactly."""
    most, total = int(np.abs(y).max(initial=0)), max((abs(s) for s in sums), default=0)
    small = y.shape[1] * most * most < 1 << 62
    squares = (y * y).sum(axis=1).astype(object) if small else (y.astype(object) ** 2).sum(axis=1)
    small = y.shape[1] * most * total < 1 << 62 and total < 1 << 62
    products = (y @ sums.astype(np.int64)).astype(object) if small else y.astype(object) @ sums
    return (n * n * squares - 2 * n * products + sum(s * s for s in sums)).tolist()


def _project(fitted: Moments, values: np.ndarray, vectors: np.ndarray, explained: np.ndarray, scale: int, offset: int):
    mean = np.array([s / fitted.n for s in fitted.sums], float)
    least = len(mean) * np.finfo(float).eps * max(float(values[0]), 0.0) if len(values) else 0.0
    flat = values <= least  # no variance beyond rounding: nothing to divide by
    basis = vectors / np.sqrt(np.where(flat, 1.0, values))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                y = integers(b.column(1), scale, offset) - fitted.shift
                found = deviations(y, fitted.n, fitted.sums)
                z = (y - mean) @ basis
                z[:, flat] = np.nan
                shares = np.broadcast_to(explained, z.shape)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(v.ravel(), from_pandas=True)) for v in (z, shares)]
                arrays = [b.column(0), pa.array([fitted.n] * len(z), pa.int64()), pa.array([d if d < 1 << 63 else None for d in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([str(d) for d in found]), *lists], names=["row", *ADDED[:5]])

    return run


def _identity_error(rows: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of `whitened` minus the identity, over components that have variance."""
    w = [F.col("whitened")[i] for i in range(k)]
    means = rows.agg(*[F.avg(x) for x in w]).first()
    some = [i for i in range(k) if means[i] is not None]
    if not some:
        return 0.0
    centred = {i: w[i] - F.lit(means[i]) for i in some}
    pairs = [(i, j) for i in some for j in some if i <= j]
    found = rows.agg(*[F.avg(centred[i] * centred[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found, strict=True))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """The rows of vectors that hold a valid vector, with n, deviation, deviation_text, whitened, explained, identity_error.

    Entries are taken as x = floor(scale * c) + offset, saturating at +-2^61. Rows whose vector is null, empty, or holds
    a null or non-finite entry are dropped and no part of the fit; vectors of each length are a fit of their own.
    n: rows of the fit. deviation: exact sum over dimensions of (n*x - S)^2 as long, null where it exceeds a long;
    deviation_text is always exact. whitened, explained: arrays by component (`components` at most, by falling
    eigenvalue); whitened is null where a component has no variance beyond rounding, explained where nothing varies.
    identity_error: how far the covariance of whitened is from the identity. Repeated rows count as often as they
    occur. Columns with the added names are replaced. An empty table gives an empty result. id_col isn't read but kept.
    """
    spark = vectors.sparkSession
    own = [c for c in vectors.columns if c.lower() not in ADDED]
    v = F.col("vector")
    fit = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.coalesce(fit, F.lit(False)))
    out = T.StructType([rows.schema["row"], T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("deviation_text", T.StringType())])
    out = out.add("whitened", T.ArrayType(T.DoubleType())).add("explained", T.ArrayType(T.DoubleType()))
    done = None
    for r in rows.select(F.size("vector").alias("dim")).distinct().collect():
        same = rows.where(F.size("vector") == r["dim"])
        fitted = exact_moments(same, "vector", r["dim"], scale, offset)
        values, basis, explained = fitted.components(components)
        part = stored(same.mapInArrow(_project(fitted, values, basis, explained, scale, offset), out), "whitened")
        part = part.withColumn("identity_error", F.lit(_identity_error(part, len(values))))
        done = part if done is None else done.unionByName(part)
    if done is None:
        done = spark.createDataFrame([], out).withColumn("identity_error", F.lit(0.0))
    return done.select("row.*", *ADDED)


def whitening_query(spark, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    every = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "e")
    found = found.select("vec_id", "n", "deviation", "deviation_text", "identity_error", every)
    return found.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("e.whitened").alias("whitened"), F.col("e.explained").alias("explained"), "identity_error", "deviation_text")
