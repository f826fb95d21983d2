"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every token hashes to a bucket, and every bucket has a fixed sparse index
vector of a few +1 and -1.  A bucket's context vector is the sum of the index
vectors of its neighbours over all documents, so it grows with the corpus while
its table has a fixed size.  A document is the mean and the spread of its
tokens' vectors, frequent tokens weighing less.  The network's probabilities are
calibrated by one temperature on rows that it did not learn from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import IS_SPACE, Hasher, crc_mod, drawn, mix, read, steps, text_of

#: Labelled rows to learn from at most, the least by a hash of the id.
TRAIN_ROWS = 40_000
THRESHOLD = 0.3
BUCKETS = 1 << 15
SIZE = 32
NONZERO = 4
NEIGHBOURS = (1, 2)
HIDDEN = 32
EPOCHS = 40
SEED = 7

#: Token classes: 0 space, 1 letters, 2 digits, 3 line ends, 4 and up each other character by itself.
KIND = np.arange(4, 260).astype(np.int32)
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
KIND[IS_SPACE] = 0
KIND[10] = 3

_h = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64).reshape(BUCKETS, NONZERO) + np.uint64(99))
#: Places and signs of the index vectors.
PLACES = (_h % np.uint64(SIZE)).astype(np.int64)
SIGNS = np.where(_h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)


def buckets_of(hasher: Hasher, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a step's tokens and their rows.  A token is a run of one class; case is kept."""
    kind, n = KIND[data], len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = np.ones(n, bool)
    begin[1:] = (kind[1:] != kind[:-1]) | edge[1:n]
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n)
    inside = kind[starts] > 0 if n else np.zeros(0, bool)
    starts, ends = starts[inside], ends[inside]
    rows = np.searchsorted(offsets, starts, "right") - 1
    return (hasher(data, starts, ends) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), rows


PLAIN = np.arange(256, dtype=np.uint8)


def contexts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Context vectors (BUCKETS x SIZE) and token counts over all documents; only this table of fixed size reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(PLAIN)
        total, count = np.zeros(BUCKETS * SIZE), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offsets in steps(batch.column(0)):
                b, rows = buckets_of(hasher, data, offsets)
                count += np.bincount(b, minlength=BUCKETS)
                for o in NEIGHBOURS:
                    near = np.flatnonzero(rows[o:] == rows[:-o])
                    for x, y in ((b[near], b[near + o]), (b[near + o], b[near])):
                        for k in range(NONZERO):
                            total += np.bincount(x * SIZE + PLACES[y, k], SIGNS[y, k], minlength=len(total))
        at = np.flatnonzero(count)
        values = np.rint(total.reshape(BUCKETS, SIZE)[at]).astype(np.int64)
        cols = [pa.array(at), pa.array(count[at]), *[pa.array(np.ascontiguousarray(v)) for v in values.T]]
        yield pa.RecordBatch.from_arrays(cols, names=["b", "n", *[f"v{k}" for k in range(SIZE)]])

    names = ["n", *[f"v{k}" for k in range(SIZE)]]
    found = docs.select(text_of().alias("text")).mapInArrow(run, ", ".join(f"{c} long" for c in ["b", *names]))
    table = found.groupBy("b").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    vectors, count = np.zeros((BUCKETS, SIZE)), np.zeros(BUCKETS)
    vectors[table["b"]] = table[names[1:]].to_numpy(float)
    count[table["b"]] = table["n"].to_numpy(float)
    return vectors, count


def word_vectors(vectors: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors without the direction that all share, and the weight of each bucket's tokens."""
    if not count.sum():
        return np.zeros((BUCKETS, SIZE), np.float32), np.ones(BUCKETS, np.float32)
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.maximum(size, 1e-9)
    share = count / count.sum()
    unit -= (unit * share[:, None]).sum(axis=0)
    unit[count == 0] = 0
    return unit.astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32)


POOLED = 2 * SIZE + 1


def pooled(unit: np.ndarray, weight: np.ndarray, b: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Weighted mean and spread of the token vectors of each row, and the logarithm of its length; zeros for a row without tokens."""
    out = np.zeros((n, POOLED))
    if not len(b):
        return out
    begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    own = rows[begin]
    for i in range(0, len(begin), 256):
        lo, hi = begin[i], begin[i + 256] if i + 256 < len(begin) else len(b)
        part = begin[i : i + 256] - lo
        w = weight[b[lo:hi]]
        total = np.add.reduceat(w, part).astype(float)[:, None]
        x = unit[b[lo:hi]]
        mean = np.add.reduceat(x * w[:, None], part, axis=0) / total
        square = np.add.reduceat(x * x * w[:, None], part, axis=0) / total
        r = own[i : i + 256]
        out[r, :SIZE], out[r, SIZE : 2 * SIZE] = mean, np.sqrt(np.maximum(square - mean**2, 0))
    out[:, -1] = np.log1p(np.bincount(rows, minlength=n))
    return out


class Network:
    """tanh layer and logistic output over standardised inputs; `temperature` divides the output before the sigmoid."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = x.mean(axis=0), x.std(axis=0) + 1e-6, 1.0
        rate = (y.sum() + 0.5) / (len(y) + 1)
        self.parts = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.full(1, np.log(rate / (1 - rate)))]
        order = rng.permutation(len(x))
        held, learn = order[: len(x) // 5], order[len(x) // 5 :]
        z = (x - self.mean) / self.scale
        first, second = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts]
        t = 0
        for epoch in range(EPOCHS):
            learn = rng.permutation(learn)
            for i in range(0, len(learn), 128):
                rows = learn[i : i + 128]
                a, c, u, d = self.parts
                h = np.tanh(z[rows] @ a + c)
                e = (1 / (1 + np.exp(-np.clip(h @ u + d, -30, 30))) - y[rows]) / len(rows)
                back = np.outer(e, u) * (1 - h * h)
                grads = [z[rows].T @ back + 1e-4 * a, back.sum(axis=0), h.T @ e + 1e-4 * u, np.array([e.sum()])]
                t += 1
                for k, g in enumerate(grads):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    rate = 3e-3 * (1 - epoch / EPOCHS)
                    self.parts[k] = self.parts[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        if len(held) >= 20:
            out, grid = self.raw(x[held]), np.exp(np.linspace(-2, 2.5, 91))
            loss = [np.logaddexp(0, -np.where(y[held] == 1, out, -out) / g).mean() for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        a, c, u, d = self.parts
        return np.tanh((x - self.mean) / self.scale @ a + c) @ u + d

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) / self.temperature, -30, 30)))


class Model:
    """Word vectors, their weights and the network; without rows of both labels, the rate of label 1."""

    def __init__(self, unit: np.ndarray, weight: np.ndarray, network: Network | None, rate: float):
        self.unit, self.weight, self.network, self.rate = unit, weight, network, rate

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.network(x) if self.network is not None else np.full(len(x), self.rate)


def pooled_batches(unit: np.ndarray, weight: np.ndarray, names: list[str], finish):
    """Batches whose last column is the text, with that column replaced by finish(pooled vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(PLAIN)
        for batch in batches:
            out = [np.zeros((0, POOLED))]
            for i, j, data, offsets in steps(batch.column(batch.num_columns - 1)):
                out.append(pooled(unit, weight, *buckets_of(hasher, data, offsets), j - i))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], finish(np.concatenate(out))], names=names)

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", held: int = 0, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from labels of rows whose crc32(id as text) mod 5 is not `held`; word vectors come from all of docs.

    At most train_rows labelled rows are used, the least by a hash of their id.
    Rows with a null id or label teach nothing; of several labels of one id the
    largest holds.
    """
    unit, weight = word_vectors(*contexts(docs))
    usable = labels.filter(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, 5) != held))
    known = (
        usable.filter(drawn(F.xxhash64(id_col), usable.count(), train_rows))
        .groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col("quality").cast("int")).alias("y"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(train_rows)
    )
    sample = docs.select(id_col, text_of().alias("text")).join(F.broadcast(known), F.col(id_col) == F.col("label_id"))
    as_list = lambda x: pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))
    rows = sample.select("y", F.xxhash64("text").alias("h"), "text").mapInArrow(pooled_batches(unit, weight, ["y", "h", "x"], as_list), "y int, h long, x array<float>").toPandas().sort_values(["h", "y"], kind="stable")
    y = rows["y"].to_numpy(float)
    rate = float((y.sum() + 0.5) / (len(y) + 1))
    network = Network(np.stack(rows["x"].to_list()).astype(float), y) if len(set(y)) == 2 else None
    return Model(unit, weight, network, rate)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, score) for every row; null text counts as empty and is scored like any other."""
    chosen = docs.select(id_col, text_of().alias("text"))
    run = pooled_batches(model.unit, model.weight, [id_col, "score"], lambda x: pa.array(model.score(x)))
    return chosen.mapInArrow(run, T.StructType([chosen.schema[id_col], T.StructField("score", T.DoubleType())]))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
