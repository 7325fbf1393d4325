"""Geometry and feature assembly for each frame: body and local frames, selection, velocity, layout, standardising.

Points are ``kp`` (array of x, y) and ``score`` (array, a point is present where it is above 0). Undetected points and
degenerate frames are kept at their size and filled with zeros.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.signal import by_time

EPS = 1e-6
_POINT = "struct<x: double, y: double>"


@dataclass(frozen=True)
class Pipeline:
    """Options of one feature pipeline, built once and handed to every job."""

    anchors: tuple[int, int] = (0, 1)
    regions: dict[str, tuple[int, ...]] = field(default_factory=dict)
    dropped: tuple[str, ...] = ()
    confidence: str = "graded"
    threshold: float = 0.3
    velocity: bool = True

    def __post_init__(self) -> None:
        if self.confidence not in ("graded", "binary"):
            raise ValueError(f"confidence is graded or binary, not {self.confidence!r}")
        lost = set(self.dropped) - set(self.regions)
        if lost:
            raise ValueError(f"no such region: {', '.join(sorted(lost))}")

    def describe(self) -> str:
        return " ".join(f"{k}={v}" for k, v in sorted(asdict(self).items()))


def anchors(points: DataFrame, names: DataFrame) -> DataFrame:
    """Points with the anchor or region name that a dimension table (idx, name) gives them; a point may have several."""
    return points.join(names, "idx")


def _zero(n: str) -> str:
    return f"transform(sequence(0, {n} - 1), i -> named_struct('x', 0.0D, 'y', 0.0D))"


def body_frame(poses: DataFrame, a: int, b: int) -> DataFrame:
    """kp moved to the middle of two anchors and divided by their distance, score, width, valid; zeros where that is undefined."""
    df = poses.withColumn("width", F.expr(f"sqrt(pow(kp[{a}].x - kp[{b}].x, 2) + pow(kp[{a}].y - kp[{b}].y, 2))"))
    df = df.withColumn("valid", F.expr(f"score[{a}] > 0 and score[{b}] > 0 and width > {EPS}"))
    moved = f"transform(kp, p -> named_struct('x', (p.x - (kp[{a}].x + kp[{b}].x) / 2) / width, 'y', (p.y - (kp[{a}].y + kp[{b}].y) / 2) / width))"
    return df.withColumns({"kp": F.expr(f"if(valid, {moved}, {_zero('size(kp)')})"), "score": F.expr("if(valid, score, transform(score, s -> 0.0D))")})


def local_frame(poses: DataFrame, idx: list[int], origin: int, scale: int, name: str) -> DataFrame:
    """Adds name_kp and name_score: the points idx about an origin point, divided by its distance to a scale point."""
    w = f"sqrt(pow(kp[{scale}].x - kp[{origin}].x, 2) + pow(kp[{scale}].y - kp[{origin}].y, 2))"
    ok = f"(score[{origin}] > 0 and score[{scale}] > 0 and {w} > {EPS})"
    lst = f"array({', '.join(map(str, idx))})"
    kp = f"transform({lst}, j -> if({ok}, named_struct('x', (kp[j].x - kp[{origin}].x) / {w}, 'y', (kp[j].y - kp[{origin}].y) / {w}), named_struct('x', 0.0D, 'y', 0.0D)))"
    return poses.withColumns({f"{name}_kp": F.expr(kp), f"{name}_score": F.expr(f"transform({lst}, j -> if({ok}, score[j], 0.0D))")})


def scale_ratio(a: int, b: int, body: tuple[int, int]) -> Column:
    """Distance of two points over the body's width, 0 where a point is missing or the width is none."""
    d = lambda p, q: f"sqrt(pow(kp[{p}].x - kp[{q}].x, 2) + pow(kp[{p}].y - kp[{q}].y, 2))"
    there = " and ".join(f"score[{i}] > 0" for i in (a, b, *body))
    return F.expr(f"if({there} and {d(*body)} > {EPS}, {d(a, b)} / {d(*body)}, 0.0D)")


def select_points(poses: DataFrame, keep: list[int]) -> DataFrame:
    lst = f"array({', '.join(map(str, keep))})"
    return poses.withColumns({"kp": F.expr(f"transform({lst}, j -> kp[j])"), "score": F.expr(f"transform({lst}, j -> score[j])")})


def confidence(mode: str, threshold: float = 0.3) -> Column:
    """Scores as they are, or 1 above the threshold and 0 else. Presence is still judged by the raw score."""
    return F.col("score") if mode == "graded" else F.transform("score", lambda s: F.when(s > threshold, 1.0).otherwise(0.0))


def zero_absent(poses: DataFrame, conf: Column) -> DataFrame:
    """Adds pts: x, y, conf of each point, all 0 where it is absent."""
    return poses.withColumn("_c", conf).withColumn("pts", F.expr("transform(kp, (p, i) -> if(score[i] > 0, struct(p.x as x, p.y as y, _c[i] as c), struct(0.0D as x, 0.0D as y, 0.0D as c)))")).drop("_c")


def velocity(frames: DataFrame) -> DataFrame:
    """Adds vel: change of each point of ``pts`` since the frame before; 0 in the first frame and where either is absent."""
    df = frames.withColumn("_was", F.lag(F.struct("pts", "score")).over(by_time()))
    v = "transform(pts, (p, i) -> if(_was is not null and score[i] > 0 and _was.score[i] > 0, struct(p.x - _was.pts[i].x as x, p.y - _was.pts[i].y as y), struct(0.0D as x, 0.0D as y)))"
    return df.withColumn("vel", F.expr(v)).drop("_was")


def interleave(frames: DataFrame, with_velocity: bool = True) -> DataFrame:
    """Adds feat: x, y, conf (and velocity) of each point after the other."""
    more = ", vel[i].x, vel[i].y" if with_velocity else ""
    return frames.withColumn("feat", F.expr(f"flatten(transform(pts, (p, i) -> array(p.x, p.y, p.c{more})))"))


def layout(blocks: dict[str, int], channels: int) -> list[tuple[str, int, int]]:
    """block, start, stop of the columns of blocks with so many points, in order."""
    out, at = [], 0
    for name, points in blocks.items():
        out.append((name, at, at + points * channels))
        at += points * channels
    return out


def append_scalars(frames: DataFrame, columns: list[str]) -> DataFrame:
    """feat with further scalars at its end, in the given order, 0 where null."""
    return frames.withColumn("feat", F.concat("feat", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])))


def fixed_length(frames: DataFrame, length: int, feature: str = "feat") -> DataFrame:
    """series, t, feature, padded: the middle ``length`` frames, or all frames and rows of zeros after them."""
    n = frames.groupBy("series").agg(F.count("*").cast("int").alias("n"), F.max(F.size(feature)).alias("_w"))
    first = F.when(F.col("n") > length, F.floor((F.col("n") - length) / 2)).otherwise(0)
    kept = frames.join(n.select("series", first.cast("int").alias("_a")), "series").where(f"t >= _a and t < _a + {length}").select("series", (F.col("t") - F.col("_a")).alias("t"), feature)
    every = n.select("series", "_w", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("t"))
    return every.join(kept, ["series", "t"], "left").select("series", "t", F.coalesce(feature, F.expr("array_repeat(0.0D, _w)")).alias(feature), F.col(feature).isNull().alias("padded"))


def fit_standardizer(frames: DataFrame, feature: str = "feat") -> DataFrame:
    """col, mean, std over all frames; a standard deviation (of the population) below 1e-6 counts as 1."""
    long = frames.select(F.posexplode(feature).alias("col", "v"))
    g = long.groupBy("col").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return g.withColumn("std", F.when(F.col("std") < 1e-6, 1.0).otherwise(F.col("std")))


def standardize(frames: DataFrame, fitted: DataFrame, feature: str = "feat") -> DataFrame:
    """Each column less its mean, over its standard deviation. The fitted table is one row of two arrays of the feature's width."""
    one = fitted.agg(F.array_sort(F.collect_list(F.struct("col", "mean", "std"))).alias("_s"))
    return frames.join(F.broadcast(one)).withColumn(feature, F.expr(f"zip_with({feature}, _s, (v, s) -> (v - s.mean) / s.std)")).drop("_s")


def confident(threshold: float = 0.5) -> Column:
    return F.transform("score", lambda s: s >= threshold)
