"""Quality classifier: kernel ridge scores over document statistics.

Random Fourier features stand in for a Gaussian kernel, each partition sums its
share of the normal equations, and an isotonic map turns ridge scores into
calibrated probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CONTINUATION, held_out, map_arrow, small_batches, stored, text_bytes, training_labels, with_labels

N_STATS = 17
#: Short words of up to this many bytes stand for function words.
SHORT = 3
UPPER = bytes(range(65, 91))


def doc_vector(text: bytes) -> tuple[float, ...]:
    """N_STATS statistics of one whole text; all finite, also for an empty one."""
    words = text.split()
    n = len(words)
    w, c = max(n, 1), max(len(text.translate(None, CONTINUATION)), 1)
    lens = np.fromiter(map(len, words), np.int64, n)
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip()]
    count = lambda drop: len(text) - len(text.translate(None, drop))
    distinct = len(set(words))
    return (
        np.log1p(c if text else 0),
        np.log1p(n),
        float(lens.mean()) if n else 0.0,
        float(lens.std()) if n else 0.0,
        distinct / w,
        distinct / np.sqrt(w),
        sum(map(eq, words, words[1:])) / w,
        count(b"#*$%&<>") / c,
        count(b"|") / w,
        count(b"0123456789") / c,
        count(UPPER) / w,
        count(b".!?") / w,
        count(b",") / w,
        np.log1p(len(full)),
        1 - len(set(full)) / max(len(full), 1),
        float((lens <= SHORT).mean()) if n else 0.0,
        np.log1p(n / max(len(full), 1)),
    )


def vectors(column: pa.Array) -> np.ndarray:
    return np.array([doc_vector(t) for t in text_bytes(column)], np.float64).reshape(-1, N_STATS)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        f = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.freq + self.phase)
        return np.hstack([f, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0.0, 1.0)


def isotonic(x: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ordered bins: block centres and their rising means."""
    blocks: list[list[float]] = []
    for a, t, k in zip(x, total, n, strict=True):
        blocks.append([a * k, t, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks, np.float64).reshape(-1, 3)
    return b[:, 0] / b[:, 2], (b[:, 1] + 0.5) / (b[:, 2] + 1.0)


def fit(docs: DataFrame, labels: DataFrame, *, modulus: int = 3, remainder: int = 1, bound: int = 20_000, n_features: int = 192, ridge: float = 1e-2, bandwidth: float = 1.5, bins: int = 128, seed: int = 11) -> Model:
    """Fit on about ``bound`` labelled rows at most, sampled by id hash.

    One row in five of the sample calibrates and takes no part in the ridge
    fit.  No labelled rows, or one class only, give a constant score.
    """
    spark = docs.sparkSession
    train = training_labels(labels, "quality", modulus, remainder, bound)

    def stats(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = vectors(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("y"), batch.column("fold"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "fold", "x"])

    rows = with_labels(docs, train).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5)).cast("int"))
    # 17 numbers for each sampled row: a bounded table that three passes read
    table = stored(map_arrow(rows.select("text", "y", "fold"), stats, "y int, fold int, x array<double>").repartition(8), "quality")

    rng = np.random.default_rng(seed)
    freq = rng.standard_normal((N_STATS, n_features)) * (1 / (bandwidth * np.sqrt(N_STATS)))
    phase = rng.random(n_features) * 2 * np.pi
    small_batches(spark)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((2, N_STATS + 1))
        for b in batches:
            x = np.array(b.column("x").to_pylist(), np.float64).reshape(-1, N_STATS)
            acc += np.vstack([np.append(x.sum(0), len(x)), np.append((x * x).sum(0), 0)])
        yield pa.RecordBatch.from_arrays([pa.array([acc.tobytes()])], names=["sums"])

    m = sum((np.frombuffer(r[0]).reshape(2, -1) for r in table.mapInArrow(moments, "sums binary").collect()), np.zeros((2, N_STATS + 1)))
    n = max(m[0, -1], 1)
    mean = m[0, :-1] / n
    scale = np.sqrt(np.maximum(m[1, :-1] / n - mean**2, 1e-12)) + 1e-6
    model = Model(mean, scale, freq, phase, np.zeros(n_features + 1), np.zeros(1), np.full(1, 0.5))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((n_features + 1, n_features + 2))
        for b in batches:
            z = model.features(np.array(b.column("x").to_pylist(), np.float64).reshape(-1, N_STATS))
            y = np.array(b.column("y").to_pylist(), np.float64)
            acc += np.hstack([z.T @ z, (z.T @ y)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([acc.tobytes()])], names=["sums"])

    parts = table.where("fold <> 0").mapInArrow(normal, "sums binary").collect()  # at most 8 rows
    a = sum((np.frombuffer(r[0]).reshape(n_features + 1, -1) for r in parts), np.zeros((n_features + 1, n_features + 2)))
    model.weight = np.linalg.solve(a[:, :-1] + ridge * np.eye(n_features + 1), a[:, -1])

    def raw(batch: pa.RecordBatch) -> pa.RecordBatch:
        r = np.clip(model.raw(np.array(batch.column("x").to_pylist(), np.float64).reshape(-1, N_STATS)), -1, 2)
        return pa.RecordBatch.from_arrays([pa.array(np.floor((r + 1) / 3 * bins).astype(np.int32)), pa.array(r), batch.column("y")], names=["bin", "r", "y"])

    cells = map_arrow(table.where("fold = 0"), raw, "bin int, r double, y int").groupBy("bin").agg(F.avg("r").alias("r"), F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    if cells:
        model.knots, model.levels = isotonic(*(np.array([float(c[k]) for c in cells]) for k in ("r", "y", "n")))
    return model


def apply(docs: DataFrame, model: Model, *, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted for each row; a null text scores as an empty one."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(vectors(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    scored = map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, *, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, that score ``threshold`` or more: one pass, no join."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.score(vectors(batch.column("text"))) >= threshold))

    return map_arrow(docs, run, docs.schema)
