"""Operators on one signal for each series: motion, spans, tempo, pauses, dropout.

Inputs have a row for each frame: ``series``, ``t`` (from 0, without gaps) and a signal such as ``energy``. All windows are by
series and ordered by t, so one exchange serves a whole chain of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from seqloom.sources.package import ship


def by_time() -> WindowSpec:
    return W.partitionBy("series").orderBy("t")


def motion_energy(poses: DataFrame) -> DataFrame:
    """energy: path length of points seen now and before, over the number seen now; 0 without points and in the first frame."""
    df = poses.withColumn("_was", F.lag(F.struct("kp", "score")).over(by_time()))
    moved = F.expr(
        "aggregate(sequence(0, size(kp) - 1), 0.0D, (a, i) -> a + if(score[i] > 0 and _was.score[i] > 0, sqrt(pow(kp[i].x - _was.kp[i].x, 2) + pow(kp[i].y - _was.kp[i].y, 2)), 0.0D))"
    )
    seen = F.expr("size(filter(score, s -> s > 0))")
    return df.withColumn("energy", F.when(F.col("_was").isNull() | (seen == 0), 0.0).otherwise(moved / seen)).drop("_was")


def active_span(frames: DataFrame, threshold: float, pad: int = 0) -> DataFrame:
    """series, n, start, stop: from the first to the last frame above the threshold, padded and clipped; all frames if none is."""
    above = F.when(F.col("energy") > threshold, F.col("t"))
    spans = frames.groupBy("series").agg(F.count("*").cast("int").alias("n"), F.min(above).alias("first"), F.max(above).alias("last"))
    start, stop = F.coalesce("first", F.lit(0)) - pad, F.coalesce("last", F.col("n") - 1) + 1 + pad
    return spans.select("series", "n", F.greatest(F.lit(0), start).alias("start"), F.least("n", stop).alias("stop"))


def capture_span(frames: DataFrame, threshold: float, preroll: int = 12, settle: int = 8) -> DataFrame:
    """series, n, start, stop as live capture would have kept them: preroll before the motion, settling after it.

    A series without motion already has its full range, which preroll and settling then only clip.
    """
    s = active_span(frames, threshold)
    return s.select("series", "n", F.greatest(F.lit(0), F.col("start") - preroll).alias("start"), F.least("n", F.col("stop") + settle).alias("stop"))


def trim(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """Frames inside their series' span, numbered from 0 again."""
    inside = frames.join(spans.select("series", "start", "stop"), "series").where("t >= start and t < stop")
    return inside.withColumn("t", F.col("t") - F.col("start")).drop("start", "stop")


def tempo(frames: DataFrame) -> DataFrame:
    """series, lag, height: place (over length) and height of the highest autocorrelation at lags from 2 on; zeros where undefined.

    Null energies count as 0. A series is one group of its (t, energy); all lags come from one transform of it, n log n in its length.
    """

    def run(key, table):
        x = table.sort_by("t").column("energy").to_numpy()
        n, place, height = len(x), 0.0, 0.0
        c = x - x.mean()
        zero = float(c @ c)
        if n >= 4 and np.abs(x).max() > 0 and zero > 1e-8:
            power = np.abs(np.fft.rfft(c, 1 << (2 * n - 1).bit_length())) ** 2
            r = np.round(np.fft.irfft(power)[2:n], 9)
            best = int(r.argmax())
            place, height = (best + 2) / n, max(-1.0, min(1.0, float(r[best]) / zero))
        return pa.table({"series": table.column("series")[:1], "lag": [place], "height": [height]})

    ship(frames.sparkSession)
    kind = frames.schema["series"].dataType.simpleString()
    rows = frames.select("series", "t", F.coalesce(F.col("energy").cast("double"), F.lit(0.0)).alias("energy"))
    return rows.groupBy("series").applyInArrow(run, f"series {kind}, lag double, height double")


def rest_fractions(spans: DataFrame, low: float = 0.2, high: float = 0.4) -> DataFrame:
    """One row: mean and median of the resting share before and after the motion, and the share of series with either in [low, high]."""
    r = spans.where("n >= 3").select((F.col("start") / F.col("n")).alias("head"), ((F.col("n") - F.col("stop")) / F.col("n")).alias("tail"))
    either = F.col("head").between(low, high) | F.col("tail").between(low, high)
    return r.agg(F.avg("head").alias("head_mean"), F.avg("tail").alias("tail_mean"), F.percentile("head", F.lit(0.5)).alias("head_median"), F.percentile("tail", F.lit(0.5)).alias("tail_median"), F.avg(either.cast("double")).alias("share"))


def dropout_rate(frames: DataFrame, seen: Column) -> DataFrame:
    """series, rate: share of frames that are not ``seen``."""
    return frames.groupBy("series").agg(F.avg(F.when(seen, 0.0).otherwise(1.0)).alias("rate"))


def jitter_floor(frames: DataFrame, least: int = 5) -> DataFrame:
    """series, floor: lower quartile of energy over frames seen now and before, where there are at least ``least`` of them."""
    both = frames.withColumn("_was", F.lag("present").over(by_time())).where("present and _was")
    return both.groupBy("series").agg(F.count("*").alias("n"), F.percentile("energy", F.lit(0.25)).alias("floor")).where(F.col("n") >= least).drop("n")


def summary(values: DataFrame, column: str) -> DataFrame:
    """One row: n, mean and 95th percentile of a column."""
    return values.agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.percentile(column, F.lit(0.95)).alias("p95"))


def dropout_by_span(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """inside (of the series' span), n, rate: dropout during and outside motion, over all series."""
    df = frames.join(spans.select("series", "start", "stop"), "series")
    inside = (F.col("t") >= F.col("start")) & (F.col("t") < F.col("stop"))
    return df.groupBy(inside.alias("inside")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("present"), 0.0).otherwise(1.0)).alias("rate"))


def stream_rate(frames: DataFrame, seconds: Column) -> DataFrame:
    """series, fps: (n - 1) over the time between first and last frame; null below two frames or without increase."""
    s = frames.select("series", seconds.alias("s")).groupBy("series").agg(F.count("*").alias("n"), F.min("s").alias("a"), F.max("s").alias("b"))
    return s.select("series", F.when((F.col("n") >= 2) & (F.col("b") > F.col("a")), (F.col("n") - 1) / (F.col("b") - F.col("a"))).alias("fps"))


def longest_pause(frames: DataFrame, threshold: float, spans: DataFrame | None = None) -> DataFrame:
    """series, pause: most frames between two neighbouring frames above the threshold inside the span; 0 with fewer than two."""
    df = frames
    if spans is not None:
        df = df.join(spans.select("series", "start", "stop"), "series").where("t >= start and t < stop")
    gap = F.col("t") - F.lag("t").over(by_time()) - 1
    gaps = df.where(F.col("energy") > threshold).select("series", gap.alias("gap")).groupBy("series").agg(F.max("gap").alias("gap"))
    return frames.select("series").distinct().join(gaps, "series", "left").select("series", F.coalesce("gap", F.lit(0)).cast("int").alias("pause"))


def resumed_motion(frames: DataFrame, threshold: float, after: Column, before: Column, least: int = 3) -> DataFrame:
    """series, resumed: whether ``least`` frames in a row are above the threshold between the places ``after`` and ``before``."""
    df = frames.where((F.col("t") > after) & (F.col("t") < before)).select("series", "t", (F.col("energy") > threshold).alias("on"))
    runs = df.withColumn("run", F.col("t") - F.row_number().over(W.partitionBy("series", "on").orderBy("t"))).where("on")
    longest = runs.groupBy("series", "run").agg(F.count("*").alias("k")).groupBy("series").agg(F.max("k").alias("k"))
    return frames.select("series").distinct().join(longest, "series", "left").select("series", (F.coalesce("k", F.lit(0)) >= least).alias("resumed"))


def source_comparison(a: DataFrame, b: DataFrame, suspicious: float = 0.5, whole: bool = True) -> DataFrame:
    """region, n, mean, median, p90, suspicious: distance of the same points in two sources, over the width of the first.

    ``a`` and ``b`` have series, t, region, i, x, y, score; ``a`` also width. Series whose frame counts differ are left out if ``whole``; else
    all frames that both sources have are compared.
    """
    other = b.select("series", "t", "i", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("score").alias("s2"))
    if whole:
        size = lambda df, name: df.groupBy("series").agg(F.max("t").alias(name))
        a = a.join(size(a, "n1").join(size(b, "n2"), "series").where("n1 = n2").select("series"), "series", "left_semi")
    both = a.join(other, ["series", "t", "i"]).where("score > 0 and s2 > 0 and width > 1e-6")
    d = F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2)) / F.col("width")
    out = both.select("region", d.alias("d")).groupBy("region").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.percentile("d", F.lit(0.5)).alias("median"), F.percentile("d", F.lit(0.9)).alias("p90"))
    return out.withColumn("suspicious", F.col("mean") > suspicious)


def swap_test(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """left, right, same, crossed, swapped: mean distance between two sources for each pair of points, straight and crosswise."""
    two = b.select("series", "t", F.col("i").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("score").alias("s2"))
    want = pairs.select("left", "right", F.explode(F.expr("transform(array(array(left, left, 0), array(right, right, 0), array(left, right, 1), array(right, left, 1)), p -> struct(p[0] as i, p[1] as j, p[2] = 1 as cross))")).alias("p")).select("left", "right", "p.*")
    met = a.select("series", "t", "i", "x", "y", "score").join(want, "i").join(two, ["series", "t", "j"]).where("score > 0 and s2 > 0")  # four rows for each pair of a topology's points
    d = F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2))
    out = met.groupBy("left", "right").agg(F.avg(F.when(~F.col("cross"), d)).alias("same"), F.avg(F.when(F.col("cross"), d)).alias("crossed"))
    return out.withColumn("swapped", F.col("crossed") < F.col("same"))


def throughput(timings: DataFrame) -> DataFrame:
    """source, frames, seconds, ms_per_frame, fps, worst: totals of a table of source, series, frames, seconds."""
    g = timings.groupBy("source").agg(F.sum("frames").alias("frames"), F.sum("seconds").alias("seconds"), F.max(F.col("seconds") / F.col("frames")).alias("worst"))
    return g.select("source", "frames", "seconds", (1000 * F.col("seconds") / F.col("frames")).alias("ms_per_frame"), (F.col("frames") / F.col("seconds")).alias("fps"), (1000 * F.col("worst")).alias("worst_ms"))
