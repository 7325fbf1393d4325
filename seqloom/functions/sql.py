"""The engine's scalar operators as SQL functions, and its row-making ones as table functions.

After ``register(spark)``, SQL has

* ``dtw(a, b)``: time warping distance of two arrays of doubles; ``edits(a, b)``: edit distance of two arrays of strings;
* ``best_class(scores)`` and ``confidence_of_best(scores)``: the first of the largest scores, and its softmax;
* ``dtw_path(a, b)``: a table of i, j for two arrays of arrays of doubles;
* ``forced_labels(log_probs, target)``: a table of t, label;
* ``attempt_frames(content, meta)``: a table of t, time, state for a binary attempt.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from seqloom.operators import match
from seqloom.sources import files

SCALAR = {
    "dtw(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": match.scalar_dtw_sql("a", "b"),
    "edits(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS INT": "aggregate(a, sequence(0, size(b)), (p, x) -> aggregate(b, array(p[0] + 1), (c, y) -> concat(c, array(least(p[size(c)] + 1, c[size(c) - 1] + 1, p[size(c) - 1] + if(x = y, 0, 1))))), p -> p[size(b)])",
    "best_class(scores ARRAY<DOUBLE>) RETURNS BIGINT": "array_position(scores, array_max(scores)) - 1",
    "confidence_of_best(scores ARRAY<DOUBLE>) RETURNS DOUBLE": "1 / aggregate(transform(scores, x -> exp(x - array_max(scores))), 0.0D, (t, x) -> t + x)",
}


class DtwPath:
    def eval(self, a: list, b: list) -> Iterator[tuple[int, int]]:
        if a and b:
            yield from match.backtrace(match.tables(match.costs(np.array([a], float), np.array([b], float)))[:, :, 0], len(a), len(b))


class ForcedLabels:
    def eval(self, log_probs: list, target: list) -> Iterator[tuple[int, int]]:
        if log_probs:
            yield from enumerate(match.forced_labels(np.array(log_probs, float), list(target)))


class AttemptFrames:
    def eval(self, content: bytes, meta: str) -> Iterator[tuple[int, float, int]]:
        times, _, _, state = files.unpack_attempt(bytes(content), json.loads(meta))
        for t, (at, s) in enumerate(zip(times, state, strict=True)):
            yield t, float(at), int(s)


def register(spark: SparkSession) -> None:
    for head, body in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("dtw_path", udtf(DtwPath, returnType="i int, j int"))
    spark.udtf.register("forced_labels", udtf(ForcedLabels, returnType="t int, label int"))
    spark.udtf.register("attempt_frames", udtf(AttemptFrames, returnType="t int, time double, state int"))
