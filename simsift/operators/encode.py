"""Encoders of sentence matrices to short vectors, and word vectors.

Networks are plain numpy; `training` fits them over all rows, encoding runs in Arrow batches with the weights broadcast.
A network is a list of layers; an autoencoder is an encoding and a decoding network.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as ft
from ..session import removed

#: Rows that are encoded at a time.
ENCODED = 256


class Layer:
    weights: tuple[str, ...] = ()

    def forward(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def backward(self, g: np.ndarray) -> np.ndarray:
        raise NotImplementedError


_ACTIVATIONS: dict[str, tuple[Callable, Callable]] = {
    "none": (lambda x: x, lambda y: np.ones_like(y)),
    "relu": (lambda x: np.maximum(x, 0), lambda y: (y > 0).astype(y.dtype)),
    "leaky": (lambda x: np.where(x > 0, x, 0.2 * x), lambda y: np.where(y > 0, 1, 0.2)),
    "sigmoid": (lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60))), lambda y: y * (1 - y)),
    "tanh": (np.tanh, lambda y: 1 - y * y),
}


class Dense(Layer):
    weights = ("w", "b")

    def __init__(self, n_in: int, n_out: int, activation: str = "none", seed: int = 0) -> None:
        bound = np.sqrt(6 / (n_in + n_out))
        self.w = np.random.default_rng(seed).uniform(-bound, bound, (n_in, n_out))
        self.b, self.activation = np.zeros(n_out), activation

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.x = x.reshape(len(x), -1)
        self.shape = x.shape
        self.y = _ACTIVATIONS[self.activation][0](self.x @ self.w + self.b)
        return self.y

    def backward(self, g: np.ndarray) -> np.ndarray:
        g = g * _ACTIVATIONS[self.activation][1](self.y)
        self.dw, self.db = self.x.T @ g, g.sum(axis=0)
        return (g @ self.w.T).reshape(self.shape)


class Maxout(Layer):
    """The largest of each run of neighbouring inputs."""

    def __init__(self, units: int) -> None:
        self.units = units

    def forward(self, x: np.ndarray) -> np.ndarray:
        flat = x.reshape(len(x), -1)
        self.shape, parts = x.shape, flat.reshape(len(x), self.units, -1)
        self.best = parts.argmax(axis=2)
        self.size = parts.shape
        return np.take_along_axis(parts, self.best[..., None], axis=2)[..., 0]

    def backward(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size, g.dtype)
        np.put_along_axis(out, self.best[..., None], g[..., None], axis=2)
        return out.reshape(self.shape)


class Reshape(Layer):
    def __init__(self, *shape: int) -> None:
        self.to = shape

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.shape = x.shape
        return x.reshape(len(x), *self.to)

    def backward(self, g: np.ndarray) -> np.ndarray:
        return g.reshape(self.shape)


class Conv(Layer):
    """Convolution of (rows, columns, channels) with zero padding, so that the result has ceil(size / stride) rows and columns."""

    weights = ("w", "b")

    def __init__(self, channels: int, filters: int, kernel: tuple[int, int], stride: int = 2, activation: str = "relu", seed: int = 0) -> None:
        n_in, n_out = kernel[0] * kernel[1] * channels, kernel[0] * kernel[1] * filters
        bound = np.sqrt(6 / (n_in + n_out))
        self.w = np.random.default_rng(seed).uniform(-bound, bound, (n_in, filters))
        self.b, self.kernel, self.stride, self.activation = np.zeros(filters), kernel, stride, activation

    def _places(self, size: int, k: int) -> tuple[np.ndarray, int, int]:
        n = -(-size // self.stride)
        pad = max((n - 1) * self.stride + k - size, 0)
        return np.arange(n)[:, None] * self.stride + np.arange(k), pad // 2, pad - pad // 2

    def forward(self, x: np.ndarray) -> np.ndarray:
        n, rows, columns, channels = x.shape
        (self.r, r0, r1), (self.c, c0, c1) = self._places(rows, self.kernel[0]), self._places(columns, self.kernel[1])
        padded = np.pad(x, ((0, 0), (r0, r1), (c0, c1), (0, 0)))
        self.crop, self.padded_shape = (slice(None), slice(r0, r0 + rows), slice(c0, c0 + columns)), padded.shape
        self.cells = padded[:, self.r[:, None, :, None], self.c[None, :, None, :]].reshape(n, len(self.r), len(self.c), -1)
        self.y = _ACTIVATIONS[self.activation][0](self.cells @ self.w + self.b)
        return self.y

    def backward(self, g: np.ndarray) -> np.ndarray:
        g = g * _ACTIVATIONS[self.activation][1](self.y)
        self.dw = np.tensordot(self.cells, g, ((0, 1, 2), (0, 1, 2)))
        self.db = g.sum(axis=(0, 1, 2))
        back = (g @ self.w.T).reshape(*g.shape[:3], *self.kernel, -1)
        out = np.zeros(self.padded_shape, back.dtype)
        along = lambda i, places: slice(i, i + self.stride * len(places), self.stride)  # noqa: E731  one cell of the kernel, at all places
        for i in range(self.kernel[0]):
            for j in range(self.kernel[1]):
                out[:, along(i, self.r), along(j, self.c)] += back[:, :, :, i, j]
        return out[self.crop]


class Upsample(Layer):
    """Each row and column `times` times; before a convolution of stride 1 it serves as a transposed one."""

    def __init__(self, times: int) -> None:
        self.times = times

    def forward(self, x: np.ndarray) -> np.ndarray:
        return x.repeat(self.times, axis=1).repeat(self.times, axis=2)

    def backward(self, g: np.ndarray) -> np.ndarray:
        n, r, c, k = g.shape
        return g.reshape(n, r // self.times, self.times, c // self.times, self.times, k).sum(axis=(2, 4))


class Network:
    def __init__(self, *layers: Layer) -> None:
        self.layers = layers

    def forward(self, x: np.ndarray) -> np.ndarray:
        for layer in self.layers:
            x = layer.forward(x)
        return x

    def backward(self, g: np.ndarray) -> np.ndarray:
        for layer in reversed(self.layers):
            g = layer.backward(g)
        return g

    def arrays(self) -> list[tuple[Layer, str]]:
        return [(layer, name) for layer in self.layers for name in layer.weights]


class Adam:
    def __init__(self, rate: float, l1: float = 0.0, l2: float = 0.0) -> None:
        self.rate, self.l1, self.l2, self.t, self.state = rate, l1, l2, 0, {}

    def step(self, networks: list[Network]) -> None:
        self.t += 1
        for n, network in enumerate(networks):
            for i, (layer, name) in enumerate(network.arrays()):
                w, g = getattr(layer, name), getattr(layer, f"d{name}")
                if name == "w":
                    g = g + self.l1 * np.sign(w) + 2 * self.l2 * w
                m, v = self.state.get((n, i), (0.0, 0.0))
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                self.state[n, i] = m, v
                w -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-7)


class Autoencoder:
    """model: fcn, cnn or maxout, over matrices of rows x width."""

    def __init__(self, model: str, width: int, latent: int = 1, rows: int = 16, seed: int = 0, last: str = "none") -> None:
        self.settings = {"model": model, "width": width, "latent": latent, "rows": rows, "seed": seed, "last": last}
        size, quarter = rows * width, (-(-rows // 4), -(-width // 4))
        if model == "fcn":
            self.encoder = Network(Dense(size, 900, "relu", seed), Dense(900, 600, "relu", seed + 1), Dense(600, latent, last, seed + 2))
            self.decoder = Network(Dense(latent, 900, "relu", seed + 3), Dense(900, size, "sigmoid", seed + 4))
        elif model == "cnn":
            flat = quarter[0] * quarter[1]
            self.encoder = Network(Reshape(rows, width, 1), Conv(1, 100, (5, latent), 2, "relu", seed), Conv(100, 200, (5, 1), 2, "relu", seed + 1), Dense(flat * 200, latent, last, seed + 2))
            self.decoder = Network(
                Dense(latent, 512, "relu", seed + 3), Dense(512, flat * 64, "relu", seed + 4), Reshape(*quarter, 64), Upsample(2),
                Conv(64, 64, (5, 1), 1, "relu", seed + 5), Upsample(2), Conv(64, 1, (5, 1), 1, "sigmoid", seed + 6),
            )
        elif model == "maxout":
            flat = quarter[0] * quarter[1]
            self.encoder = Network(Reshape(rows, width, 1), Conv(1, 300, (5, 1), 2, "relu", seed), Conv(300, 600, (5, 1), 2, "relu", seed + 1), Maxout(300), Dense(300, latent, "sigmoid", seed + 2))
            self.decoder = Network(Dense(latent, 300, "relu", seed + 3), Dense(300, size, "tanh", seed + 4))
        else:
            raise ValueError(f"no model {model!r}")

    def encode(self, x: np.ndarray) -> np.ndarray:
        return self.encoder.forward(x)

    def loss(self, x: np.ndarray, target: np.ndarray) -> float:
        out = self.decoder.forward(self.encode(x)).reshape(len(x), -1)[:, : target.shape[1]]
        return float(((out - target) ** 2).mean())

    def _reconstruct(self, x: np.ndarray, target: np.ndarray) -> float:
        out = self.decoder.forward(self.encode(x))
        flat = out.reshape(len(x), -1)
        error = flat[:, : target.shape[1]] - target
        g = np.zeros_like(flat)
        g[:, : target.shape[1]] = 2 * error / error.size
        self.latent_gradient = self.decoder.backward(g.reshape(out.shape))
        return float((error**2).mean())

    def fit(self, data: Callable[[int, int], tuple[np.ndarray, np.ndarray]], epochs: int = 5, rate: float = 1e-4, l1: float = 0.0, l2: float = 0.0, batch: int = 4, max_drop: int = 10, max_swap: int = 10, adversarial: bool = False, latent_weight: float = 1.0) -> list[tuple[int, str, float]]:
        """Train on data(drop, swap) -> (x, x_hat), with less noise from epoch to epoch. Returns (epoch, name, loss).

        adversarial adds a discriminator that tells latent vectors from fair coin flips, and pushes the encoder to fool it.
        """
        adam, judge_adam, out = Adam(rate, l1, l2), Adam(rate), []
        latent, rng = self.settings["latent"], np.random.default_rng(self.settings["seed"])
        judge = Network(Dense(latent, 64, "leaky", 7), Dense(64, 32, "leaky", 8), Dense(32, 1, "sigmoid", 9))
        for epoch in range(epochs):
            drop, swap = (max(0, most - int(epoch / epochs * most)) for most in (max_drop, max_swap))
            x, target = data(drop, swap)
            losses, judged = [], []
            for i in range(0, len(x), batch):
                a, b = x[i : i + batch], target[i : i + batch]
                losses.append(self._reconstruct(a, b))
                g = self.latent_gradient
                if adversarial:
                    code = self.encode(a)
                    p = judge.forward(code)
                    g = g + latent_weight * judge.backward((p - 1) / np.maximum(p * (1 - p), 1e-6) / len(p))
                    self.encoder.backward(g)
                    adam.step([self.encoder, self.decoder])
                    both, truth = np.concatenate((code, rng.integers(0, 2, code.shape))), np.repeat([0.0, 1.0], len(code))[:, None]
                    p = judge.forward(both)
                    judged.append(float(-(truth * np.log(p + 1e-9) + (1 - truth) * np.log(1 - p + 1e-9)).mean()))
                    judge.backward((p - truth) / np.maximum(p * (1 - p), 1e-6) / len(p))
                    judge_adam.step([judge])
                else:
                    self.encoder.backward(g)
                    adam.step([self.encoder, self.decoder])
            out.append((epoch, "reconstruction", float(np.mean(losses))))
            if judged:
                out.append((epoch, "discriminator", float(np.mean(judged))))
        return out

    def save(self, spark: SparkSession, path: str, keep: int = 5) -> None:
        """Add a checkpoint of the weights to path; numbers of checkpoints go up, and only the last `keep` stay."""
        checkpoint(spark, path, self.settings, [self.encoder, self.decoder], keep)

    @classmethod
    def load(cls, spark: SparkSession, path: str, number: int | None = None) -> Autoencoder:
        settings, _, arrays = restored(spark, path, number)
        out = cls(**settings)
        for (n, i), (w, _, _) in arrays.items():
            if n < 2:
                layer, name = (out.encoder, out.decoder)[n].arrays()[i]
                setattr(layer, name, w)
        return out


_LOADED: dict[tuple[str, int], Autoencoder] = {}


def cached(spark: SparkSession, path: str, number: int | None = None) -> Autoencoder:
    """The encoder of a checkpoint of path, the last if none is named; loaded once, and again when there is a newer one."""
    number = number or max(r[0] for r in _numbers(spark, path))
    if (path, number) not in _LOADED:
        for old in [k for k in _LOADED if k[0] == path]:
            del _LOADED[old]
        _LOADED[path, number] = Autoencoder.load(spark, path, number)
    return _LOADED[path, number]


def checkpoint(spark: SparkSession, path: str, settings: dict, networks: list[Network], keep: int, state: dict | None = None, moments: dict | None = None) -> None:
    """Add the networks' arrays to path under a new number, with the optimizer's state and moments if there are any."""
    before = sorted(int(r[0]) for r in _numbers(spark, path))
    number = max(before, default=0) + 1
    columns: dict[str, list] = {c: [] for c in ("settings", "state", "network", "layer", "shape", "value", "m", "v")}
    for n, network in enumerate(networks):
        for i, (layer, name) in enumerate(network.arrays()):
            w, (m, v) = getattr(layer, name), (moments or {}).get((n, i), (None, None))
            binary = [None if x is None else np.asarray(x, float).tobytes() for x in (w, m, v)]
            for c, x in zip(columns, (json.dumps(settings), json.dumps(state), n, i, list(w.shape), *binary), strict=True):
                columns[c].append(x)
    kinds = pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()
    rows = spark.createDataFrame(pa.table([pa.array(x, t) for x, t in zip(columns.values(), kinds, strict=True)], names=list(columns)))
    rows.withColumn("number", F.lit(number)).coalesce(1).write.mode("append").partitionBy("number").parquet(path)
    for old in [*before, number][:-keep]:
        removed(spark, f"{path}/number={old}")


def restored(spark: SparkSession, path: str, number: int | None = None) -> tuple[dict, dict | None, dict] | None:
    """(settings, state, arrays by network and layer) of the last checkpoint of path, or None without any."""
    number = number or max((r[0] for r in _numbers(spark, path)), default=None)
    if number is None:
        return None
    rows = spark.read.parquet(path).where(F.col("number") == number).collect()
    array = lambda value, shape: None if value is None else np.frombuffer(value, float).reshape(shape).copy()
    arrays = {(r["network"], r["layer"]): tuple(array(r[c], r["shape"]) for c in ("value", "m", "v")) for r in rows}
    return json.loads(rows[0]["settings"]), json.loads(rows[0]["state"]), arrays


def _numbers(spark: SparkSession, path: str) -> list:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path).select("number").distinct().collect()
    except AnalysisException:
        return []


def noisy(x: np.ndarray, words: int, drop: int, swap: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(x, target) of flat matrices of so many words: in each, `drop` random words of x are zeroed, and then `swap`
    random words are permuted, alike in x and target."""
    shape = (len(x), words, -1)
    x, target, rows = x.reshape(shape).copy(), x.reshape(shape).copy(), np.arange(len(x))[:, None]
    x[rows, rng.random((len(x), words)).argsort(axis=1)[:, :drop]] = 0
    at = rng.random((len(x), words)).argsort(axis=1)[:, :swap]
    to = rng.permuted(at, axis=1)
    x[rows, to], target[rows, to] = x[rows, at], target[rows, at]
    return x.reshape(len(x), -1), target.reshape(len(x), -1)


def projection(width: int, latent: int, seed: int = 0) -> np.ndarray:
    """A random projection with entries -1, 0 and 1, the same for a seed."""
    return np.random.default_rng(seed).integers(-1, 2, (width, latent)).astype(float)


def principal(vectors: DataFrame, latent: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and first `latent` principal axes of vectors.vec, over all rows: sums and products by task are added up."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1) if b.num_rows else None
            if x is not None:
                one = np.column_stack((np.ones(len(x)), x))  # so that counts and sums are products too
                total = one.T @ one if total is None else total + one.T @ one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    cells = vectors.select("vec").mapInArrow(moments, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    found = cells.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((found["i"].max() + 1,) * 2)
    total[found["i"], found["j"]] = found["v"]
    n, mean = total[0, 0], total[0, 1:] / total[0, 0]
    return mean, np.linalg.eigh(total[1:, 1:] / n - np.outer(mean, mean))[1][:, ::-1][:, :latent]


def encode(rows: DataFrame, function: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(id, code) of rows (id, x): codes of flat matrices by `function`, from a batch of rows to a batch of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ENCODED):
                b = batch.slice(i, ENCODED)
                codes = function(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)).astype(np.float32)
                ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * codes.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))], names=["id", "code"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "x").mapInArrow(run, f"id {kind}, code array<float>")


def train_word_vectors(sentences: DataFrame, size: int = 200, window: int = 10, min_count: int = 1, seed: int = 1) -> DataFrame:
    """(word, vec) learned from sentences.words."""
    parts = max(1, sentences.sparkSession.sparkContext.defaultParallelism)
    model = Word2Vec(numPartitions=parts, vectorSize=size, windowSize=window, minCount=min_count, seed=seed, inputCol="words", outputCol="out").fit(sentences)
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select("word", vector_to_array("vector", "float32").alias("vec"))


def save_word_vectors(vectors: DataFrame, path: str) -> None:
    """Write (word, vec), as a vocabulary that load_word_vectors reads."""
    vectors.select("word", "vec").write.mode("overwrite").parquet(path)


def load_word_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """What save_word_vectors wrote, or None if there is nothing."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def _vectors(tokens: DataFrame, vocabulary: DataFrame, size: int, limit: int | None) -> DataFrame:
    placed = tokens.select("id", F.posexplode("tokens").alias("place", "word"))
    placed = placed if limit is None else placed.where(F.col("place") < limit)
    unknown = F.array_repeat(F.lit(ft.UNKNOWN), size)
    return placed.join(vocabulary, "word", "left").select("id", "place", F.coalesce(F.col("vec").cast("array<double>"), unknown).alias("vec"))


def sentence_matrix(tokens: DataFrame, vocabulary: DataFrame, size: int = 200, rows: int = 16) -> DataFrame:
    """(id, matrix) of tokens (id, tokens): vectors of the first words, zero rows, then [-0.0005, 0.0005] to [0, 1]."""
    cells = _vectors(tokens, vocabulary, size, rows).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "vec"))).alias("cells"))
    flat = F.flatten(F.transform("cells", lambda c: c["vec"]))
    padded = F.slice(F.concat(flat, F.array_repeat(F.lit(0.0), rows * size)), 1, rows * size)
    return cells.select("id", ft.rescale(padded, -0.0005, 0.0005, 0.0, 1.0).alias("matrix"))


def mean_vector(tokens: DataFrame, vocabulary: DataFrame, size: int = 512, cells: int = 512) -> DataFrame:
    """(id, vec): mean of the words' vectors, resized to `cells` (a matrix of 16 x 32), [-0.0005, 0.0005] to [-1, 1];
    titles without words give the middle."""
    placed = _vectors(tokens, vocabulary, size, None).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "vec"))).alias("cells"))
    total = F.aggregate("cells", F.array_repeat(F.lit(0.0), size), lambda s, c: F.zip_with(s, c["vec"], lambda x, y: x + y))
    means = placed.select("id", ft.bind(total, lambda t: F.transform(t, lambda x: x / F.size("cells"))).alias("vec"))
    zero = F.array_repeat(F.lit(0.0), size)
    return tokens.select("id").join(means, "id", "left").select("id", ft.rescale(ft.resized(F.coalesce("vec", zero), cells), -0.0005, 0.0005, -1.0, 1.0).alias("vec"))
