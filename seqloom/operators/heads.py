"""Verdict heads: one linear classifier for each parameter on pooled features, fitted together.

A clip's features are the mean and largest value of each column over its frames; the two hands' columns are merged by the larger value, so that it does not matter which
hand moves. Each head sees columns of its own. The loss is the sum of the heads' mean cross entropies (a head of two classes is a logistic one); a clip whose
label is null for a head does not count there. Each step of the quasi-Newton fit reads the data once: tasks sum loss and gradient of all heads over their rows, Spark adds them up,
and the driver gets one number for each weight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.fold import arrow_schema
from seqloom.operators.verdict import merge_max, pool
from seqloom.sources.package import ship
from seqloom.sources.store import discarded, fresh_path


def pooled(frames: DataFrame, feature: str, left: list[int], right: list[int], rest: list[int]) -> DataFrame:
    """series, feat: merged hands (means, then largest values), then the other columns (means, then largest values)."""
    g = pool(frames, feature).groupBy("series").agg(F.array_sort(F.collect_list(F.struct("col", "mean", "top"))).alias("x"))  # a row for each column
    pick = lambda name, columns: F.transform(F.array(*[F.lit(c) for c in columns]), lambda i: F.get(F.col("x"), i)[name])
    hands = [merge_max(pick(name, left), pick(name, right)) for name in ("mean", "top")]
    return g.select("series", F.concat(*hands, pick("mean", rest), pick("top", rest)).alias("feat"))


@dataclass(frozen=True)
class Model:
    """Classes and columns of each head, weights (classes by columns and one more), and what standardises the features."""

    classes: dict[str, list[str]]
    columns: dict[str, list[int]]
    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def log_probabilities(self, features: np.ndarray) -> dict[str, np.ndarray]:
        x = (features - self.mean) / self.scale
        return {name: log_softmax(_with_one(x[:, self.columns[name]]) @ w.T) for name, w in self.weights.items()}


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, memory: int = 8, enough: float = 1e-4) -> np.ndarray:
    """Limited-memory quasi-Newton descent; ``f`` gives value and gradient."""
    x, (value, g) = start, f(start)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(g).max() < enough:
            break
        d, weights = -g, []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            weights.append(a)
            d = d - a * y
        if pairs:
            s, y = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(weights), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        length = 1.0 if pairs else min(1.0, 1 / np.abs(g).sum())
        while True:
            there = x + length * d
            found, h = f(there)
            if found <= value + 1e-4 * length * (g @ d) or length < 1e-6:
                break
            length /= 2
        if (h - g) @ (there - x) > 1e-12:
            pairs = [*pairs, (there - x, h - g)][-memory:]
        x, value, g = there, found, h
    return x


def fit(train: DataFrame, heads: dict[str, list[int]], steps: int = 20, ridge: float = 1e-3) -> Model:
    """Fit all heads to ``train`` (feat: array of doubles; a string column for each head); ``heads`` has each one's feature columns."""
    spark = train.sparkSession
    ship(spark)
    path = fresh_path(spark, "heads")
    train.select("feat", *heads).write.parquet(path)
    rows = spark.read.parquet(discarded(spark, path))
    classes = {name: [r[0] for r in rows.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name).collect()] for name in heads}  # classes are few
    counts = rows.agg(*[F.count(name).alias(name) for name in heads]).first()
    spread = rows.select(F.posexplode("feat").alias("i", "v")).groupBy("i").agg(F.avg("v"), F.stddev_pop("v")).orderBy("i").collect()  # a row for each column
    mean, scale = np.array([r[1] for r in spread]), np.array([r[2] if r[2] > 1e-9 else 1.0 for r in spread])
    shapes = {name: (len(classes[name]), len(columns) + 1) for name, columns in heads.items()}
    edges = np.cumsum([0] + [a * b for a, b in shapes.values()])
    out = pa.schema([("i", pa.int32()), ("v", pa.float64())])

    def model(theta: np.ndarray) -> Model:
        return Model(classes, heads, {name: theta[s:e].reshape(shape) for (name, shape), s, e in zip(shapes.items(), edges[:-1], edges[1:], strict=True)}, mean, scale)

    def total(theta: np.ndarray) -> tuple[float, np.ndarray]:
        now = model(theta)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(theta) + 1)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.array(batch.column("feat").to_pylist(), float)
                scaled = (x - mean) / scale
                for k, (name, logs) in enumerate(now.log_probabilities(x).items()):
                    place = {c: i for i, c in enumerate(classes[name])}
                    y = np.array([place.get(v, -1) for v in batch.column(name).to_pylist()])
                    known = y >= 0
                    wrong = np.exp(logs[known])
                    wrong[np.arange(len(wrong)), y[known]] -= 1
                    sums[0] -= logs[known, y[known]].sum() / counts[name]
                    sums[1 + edges[k] : 1 + edges[k + 1]] += (wrong.T @ _with_one(scaled[known][:, heads[name]]) / counts[name]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], schema=out)

        summed = np.zeros(len(theta) + 1)
        for r in rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            summed[r["i"]] = r["v"]
        return summed[0] + ridge / 2 * theta @ theta, summed[1:] + ridge * theta

    return model(minimised(total, np.zeros(edges[-1]), steps))


def verdicts(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` without feat, once for each head: parameter, predicted (the first of the likeliest), confidence; nulls where feat is null."""
    ship(rows.sparkSession)
    keep = [c for c in rows.columns if c != "feat"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", parameter string, predicted string, confidence double"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feats = batch.column("feat").to_pylist()
            known = np.array([f is not None for f in feats], bool)
            logs = model.log_probabilities(np.array([f for f in feats if f is not None], float).reshape(int(known.sum()), len(model.mean)))
            for name, found in logs.items():
                said, sure = [None] * len(feats), [None] * len(feats)
                for at, k, p in zip(np.flatnonzero(known).tolist(), found.argmax(axis=1).tolist() if len(found) else [], np.exp(found.max(axis=1)).tolist() if len(found) else [], strict=True):
                    said[at], sure[at] = model.classes[name][k], p
                columns = [*(batch.column(c) for c in keep), pa.array([name] * len(feats)), pa.array(said, pa.string()), pa.array(sure, pa.float64())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, ddl)
