"""Geometry and features on the embeddings, read as poses of 32 points."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import geometry as op
from seqloom.operators import signal
from seqloom.plans.bind import POINTS, poses
from seqloom.plans.registry import query

_AT = """anc AS (SELECT series, t, max(x) FILTER (WHERE i = 0) AS x0, max(y) FILTER (WHERE i = 0) AS y0, max(x) FILTER (WHERE i = 1) AS x1, max(y) FILTER (WHERE i = 1) AS y1,
 max(x) FILTER (WHERE i = 9) AS x9, max(y) FILTER (WHERE i = 9) AS y9, max(score) FILTER (WHERE i = 9) AS s9, max(x) FILTER (WHERE i = 8) AS x8, max(y) FILTER (WHERE i = 8) AS y8, max(score) FILTER (WHERE i = 8) AS s8,
 max(score) FILTER (WHERE i = 0) AS s0, max(score) FILTER (WHERE i = 1) AS s1 FROM points GROUP BY series, t)"""
_BODY = f"""{POINTS}, {_AT}, b AS (SELECT series, t, i, sqrt((x0 - x1) ** 2 + (y0 - y1) ** 2) AS width, s0 > 0 AND s1 > 0 AND sqrt((x0 - x1) ** 2 + (y0 - y1) ** 2) > 1e-6 AS valid, x, y, score, (x0 + x1) / 2 AS ox, (y0 + y1) / 2 AS oy FROM points JOIN anc USING (series, t)),
body AS (SELECT series, t, i, width, valid, CASE WHEN valid THEN (x - ox) / width ELSE 0 END AS x, CASE WHEN valid THEN (y - oy) / width ELSE 0 END AS y, CASE WHEN valid THEN score ELSE 0 END AS score FROM b)"""


def _points(df, kp="kp", score="score"):
    return df.select("series", "t", F.expr(f"posexplode(arrays_zip({kp}, {score})) as (i, p)")).select("series", "t", "i", F.round(F.col("p")[kp]["x"], 6).alias("x"), F.round(F.col("p")[kp]["y"], 6).alias("y"), F.round(F.col("p")[score], 6).alias("score"))


@query("g1_anchors", f"WITH {POINTS}, n(idx, name) AS (VALUES (0, 'left'), (1, 'right'), (8, 'hand'), (9, 'hand'), (9, 'tip')) SELECT name, count(*) AS n, round(avg(x), 6) AS x FROM points JOIN n ON i = idx GROUP BY name")
def anchors(spark, sf_dir):
    names = spark.createDataFrame([(0, "left"), (1, "right"), (8, "hand"), (9, "hand"), (9, "tip")], "idx int, name string")
    long = poses(spark, sf_dir).select(F.posexplode("kp").alias("idx", "p")).select("idx", "p.x")
    return op.anchors(long, names).groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("x"))


@query("g2_body_frame", f"WITH {_BODY} SELECT series, t, i, round(x, 6) AS x, round(y, 6) AS y, round(score, 6) AS score FROM body")
def body_frame(spark, sf_dir):
    return _points(op.body_frame(poses(spark, sf_dir), 0, 1))


@query("g3_local_frame", f"""WITH {POINTS}, {_AT}, w AS (SELECT *, sqrt((x9 - x8) ** 2 + (y9 - y8) ** 2) AS w FROM anc), j AS (SELECT p.series, p.t, p.i - 8 AS i, x, y, x8, y8, w, score, s8 > 0 AND s9 > 0 AND w > 1e-6 AS ok FROM points p JOIN w USING (series, t) WHERE i BETWEEN 8 AND 15)
SELECT series, t, CAST(i AS INT) AS i, round(CASE WHEN ok THEN (x - x8) / w ELSE 0 END, 6) AS x, round(CASE WHEN ok THEN (y - y8) / w ELSE 0 END, 6) AS y, round(CASE WHEN ok THEN score ELSE 0 END, 6) AS score FROM j""")
def local_frame(spark, sf_dir):
    return _points(op.local_frame(poses(spark, sf_dir), list(range(8, 16)), 8, 9, "hand"), "hand_kp", "hand_score")


@query("g4_scale_ratio", f"""WITH {POINTS}, {_AT} SELECT series, t, round(CASE WHEN s0 > 0 AND s1 > 0 AND s8 > 0 AND s9 > 0 AND sqrt((x0 - x1) ** 2 + (y0 - y1) ** 2) > 1e-6
 THEN sqrt((x8 - x9) ** 2 + (y8 - y9) ** 2) / sqrt((x0 - x1) ** 2 + (y0 - y1) ** 2) ELSE 0 END, 6) AS ratio FROM anc""")
def scale_ratio(spark, sf_dir):
    return poses(spark, sf_dir).select("series", "t", F.round(op.scale_ratio(8, 9, (0, 1)), 6).alias("ratio"))


_KEEP = [i for i in range(32) if not 16 <= i < 24]


@query("g5_select_points", f"WITH {POINTS} SELECT series, t, CAST(CASE WHEN i < 16 THEN i ELSE i - 8 END AS INT) AS i, round(x, 6) AS x, round(y, 6) AS y, round(score, 6) AS score FROM points WHERE i < 16 OR i >= 24")
def select_points(spark, sf_dir):
    return _points(op.select_points(poses(spark, sf_dir), _KEEP))


@query("g6_confidence", f"WITH {POINTS} SELECT series, t, sum(CASE WHEN score > 0.3 THEN 1.0 ELSE 0.0 END) AS binary, round(sum(score), 6) AS graded FROM points GROUP BY 1, 2")
def confidence(spark, sf_dir):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return poses(spark, sf_dir).select("series", "t", total(op.confidence("binary")).alias("binary"), F.round(total(op.confidence("graded")), 6).alias("graded"))


_FEAT = f"""{POINTS}, z AS (SELECT series, t, i, score, CASE WHEN score > 0 THEN x ELSE 0 END AS x, CASE WHEN score > 0 THEN y ELSE 0 END AS y, score AS c FROM points),
v AS (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(score) OVER o AS ps FROM z WINDOW o AS (PARTITION BY series, i ORDER BY t)),
f AS (SELECT series, t, i, x, y, c, CASE WHEN score > 0 AND ps > 0 THEN x - px ELSE 0 END AS vx, CASE WHEN score > 0 AND ps > 0 THEN y - py ELSE 0 END AS vy FROM v),
long AS (SELECT series, t, 5 * i + k AS col, CASE k WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN c WHEN 3 THEN vx ELSE vy END AS v FROM f, (SELECT unnest(range(0, 5)) AS k))"""


def features(spark, sf_dir, velocity=True):
    df = op.zero_absent(poses(spark, sf_dir), op.confidence("graded"))
    return op.interleave(op.velocity(df)).select("series", "t", "label", "feat")


@query("g7_zero_absent", f"WITH {_FEAT} SELECT series, t, i, round(x, 6) AS x, round(y, 6) AS y, round(c, 6) AS c FROM z")
def zero_absent(spark, sf_dir):
    df = op.zero_absent(poses(spark, sf_dir), op.confidence("graded"))
    return df.select("series", "t", F.posexplode("pts").alias("i", "p")).select("series", "t", "i", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"), F.round("p.c", 6).alias("c"))


@query("g8_velocity", f"WITH {_FEAT} SELECT series, t, i, round(vx, 6) AS vx, round(vy, 6) AS vy FROM f")
def velocity(spark, sf_dir):
    df = op.velocity(op.zero_absent(poses(spark, sf_dir), op.confidence("graded")))
    return df.select("series", "t", F.posexplode("vel").alias("i", "p")).select("series", "t", "i", F.round("p.x", 6).alias("vx"), F.round("p.y", 6).alias("vy"))


@query("g9_interleave", f"WITH {_FEAT} SELECT series, t, col, round(v, 6) AS v FROM long")
def interleave(spark, sf_dir):
    return features(spark, sf_dir).select("series", "t", F.posexplode("feat").alias("col", "v")).withColumn("v", F.round("v", 6))


@query("g10_append_scalars", f"WITH {_FEAT} SELECT series, t, count(*) + 4 AS width, round(sum(v) + max(CASE WHEN t % 3 = 0 THEN 0 ELSE t END) + 7, 6) AS total FROM long GROUP BY 1, 2")
def append_scalars(spark, sf_dir):
    df = features(spark, sf_dir).withColumns({"d0": F.when(F.col("t") % 3 != 0, F.col("t")), "d1": F.lit(7), "d2": F.lit(None), "d3": F.lit(0)})
    df = op.append_scalars(df, ["d0", "d1", "d2", "d3"])
    return df.select("series", "t", F.size("feat").alias("width"), F.round(F.aggregate("feat", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("g11_fixed_length", f"""WITH {_FEAT}, n AS (SELECT series, count(DISTINCT t) AS n FROM long GROUP BY 1), s AS (SELECT series, t, round(sum(abs(v)), 6) AS total FROM long GROUP BY 1, 2),
e AS (SELECT series, n, CASE WHEN series % 2 = 0 THEN 6 ELSE 13 END AS len FROM n), r AS (SELECT series, len, CASE WHEN n > len THEN (n - len) // 2 ELSE 0 END AS a, unnest(range(0, len)) AS t FROM e)
SELECT r.series, CAST(r.t AS INT) AS t, coalesce(total, 0) AS total, total IS NULL AS padded FROM r LEFT JOIN s ON s.series = r.series AND s.t = r.t + r.a""")
def fixed_length(spark, sf_dir):
    f = features(spark, sf_dir)
    both = op.fixed_length(f.where("series % 2 = 0"), 6).union(op.fixed_length(f.where("series % 2 = 1"), 13))
    return both.select("series", "t", F.round(F.aggregate("feat", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("total"), "padded")


_FIT = "fit AS (SELECT col, avg(v) AS mean, CASE WHEN stddev_pop(v) < 1e-6 THEN 1 ELSE stddev_pop(v) END AS std FROM long WHERE series % 5 < 4 GROUP BY col)"


@query("g12_fit_standardizer", f"WITH {_FEAT}, {_FIT} SELECT col, round(mean, 6) AS mean, round(std, 6) AS std FROM fit")
def fit_standardizer(spark, sf_dir):
    return op.fit_standardizer(features(spark, sf_dir).where("series % 5 < 4")).select("col", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("g13_standardize", f"WITH {_FEAT}, {_FIT} SELECT series, t, col, round((v - mean) / std, 5) AS v FROM long JOIN fit USING (col)")
def standardize(spark, sf_dir):
    f = features(spark, sf_dir)
    return op.standardize(f, op.fit_standardizer(f.where("series % 5 < 4"))).select("series", "t", F.posexplode("feat").alias("col", "v")).withColumn("v", F.round("v", 5))


@query("g14_pipeline", f"WITH {_BODY}, k AS (SELECT series, t, CASE WHEN score > 0.4 THEN 1.0 ELSE 0.0 END AS c, score FROM body WHERE i < 16 OR i >= 24) SELECT series, t, count(*) AS points, sum(CASE WHEN score > 0 THEN c ELSE 0 END) AS confident FROM k GROUP BY 1, 2")
def pipeline(spark, sf_dir):
    p = op.Pipeline(regions={"face": tuple(range(16, 24))}, dropped=("face",), confidence="binary", threshold=0.4, velocity=False)
    out = {i for r in p.dropped for i in p.regions[r]}
    df = op.select_points(op.body_frame(poses(spark, sf_dir), *p.anchors), [i for i in range(32) if i not in out])
    df = op.zero_absent(df, op.confidence(p.confidence, p.threshold))
    return df.select("series", "t", F.size("pts").alias("points"), F.aggregate("pts", F.lit(0.0), lambda a, x: a + x["c"]).alias("confident"))


@query("g15_confident", f"WITH {POINTS} SELECT series, t, count(*) FILTER (WHERE score >= 0.5) AS n FROM points GROUP BY 1, 2")
def confident(spark, sf_dir):
    return poses(spark, sf_dir).select("series", "t", F.size(F.filter(op.confident(), lambda x: x)).alias("n"))


@query("g16_live_shaped", f"""WITH {_FEAT}, w AS (SELECT *, lag(x) OVER o AS qx, lag(y) OVER o AS qy, lag(score) OVER o AS qs FROM points WINDOW o AS (PARTITION BY series, i ORDER BY t)),
e AS (SELECT series, t, CASE WHEN t = 0 OR count(*) FILTER (WHERE score > 0) = 0 THEN 0 ELSE sum(CASE WHEN score > 0 AND qs > 0 THEN sqrt((x - qx) ** 2 + (y - qy) ** 2) ELSE 0 END) / count(*) FILTER (WHERE score > 0) END AS energy FROM w GROUP BY 1, 2),
a AS (SELECT series, count(*) AS n, min(t) FILTER (WHERE energy > 0.17) AS a, max(t) FILTER (WHERE energy > 0.17) AS b FROM e GROUP BY series),
s AS (SELECT series, greatest(0, coalesce(a, 0) - 1) AS start, least(n, coalesce(b, n - 1) + 1 + 1) AS stop FROM a)
SELECT series, t - start AS t, round(sum(v), 6) AS total FROM long JOIN s USING (series) WHERE t >= start AND t < stop GROUP BY series, t, start""")
def live_shaped(spark, sf_dir):
    p = poses(spark, sf_dir)
    span = signal.capture_span(signal.motion_energy(p), 0.17, preroll=1, settle=1)
    return signal.trim(features(spark, sf_dir), span).select("series", "t", F.round(F.aggregate("feat", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
