"""Signal and geometry operators on small made-up series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import geometry, signal


def frames(spark, *energies):
    rows = [(k, t, float(e), True) for k, es in enumerate(energies) for t, e in enumerate(es)]
    return spark.createDataFrame(rows, "series long, t int, energy double, present boolean")


def by_series(df, *cols):
    return {r["series"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_spans(spark):
    f = frames(spark, [0, 0, 5, 0, 5, 0, 0, 0], [0, 0, 0], [5, 5])
    assert by_series(signal.active_span(f, 1), "start", "stop") == {0: (2, 5), 1: (0, 3), 2: (0, 2)}
    assert by_series(signal.active_span(f, 1, 3), "start", "stop") == {0: (0, 8), 1: (0, 3), 2: (0, 2)}
    assert by_series(signal.active_span(f, 5), "start", "stop")[0] == (0, 8)  # strictly above
    assert by_series(signal.capture_span(f, 1, 1, 2), "start", "stop") == {0: (1, 7), 1: (0, 3), 2: (0, 2)}
    cut = signal.trim(f, signal.active_span(f, 1)).where("series = 0").orderBy("t").collect()
    assert [(r["t"], r["energy"]) for r in cut] == [(0, 5), (1, 0), (2, 5)]


def test_tempo_equals_fft(spark):
    rng = np.random.default_rng(0)
    found = [rng.random(n) + np.sin(np.arange(n)) + 1 for n in (4, 9, 30, 64)] + [np.zeros(8), np.ones(8), np.ones(3)]
    got = by_series(signal.tempo(frames(spark, *found)), "lag", "height")
    for k, e in enumerate(found):
        x = e - e.mean()
        acf = np.correlate(x, x, "full")[len(x) - 1 :]
        if len(e) < 4 or not e.any() or acf[0] <= 1e-8:
            assert got[k] == (0, 0)
            continue
        best = 2 + int(np.argmax(acf[2:]))
        assert got[k] == (pytest.approx(best / len(e)), pytest.approx(acf[best] / acf[0], abs=1e-6))


def test_pauses_and_runs(spark):
    f = frames(spark, [0, 5, 0, 0, 0, 5, 0, 5], [0, 0], [0, 5, 0])
    assert by_series(signal.longest_pause(f, 1), "pause") == {0: (3,), 1: (0,), 2: (0,)}
    g = frames(spark, [5, 5, 0, 5, 5, 5, 0], [0, 5, 5, 0, 5, 5, 0])
    assert by_series(signal.resumed_motion(g, 1, F.lit(1), F.lit(7)), "resumed") == {0: (True,), 1: (False,)}


def poses(spark, kp, score):
    rows = [(0, t, [tuple(map(float, p)) for p in k], [float(x) for x in s]) for t, (k, s) in enumerate(zip(kp, score, strict=True))]
    return spark.createDataFrame(rows, "series long, t int, kp array<struct<x: double, y: double>>, score array<double>")


def test_motion_energy_counts_points_seen_now(spark):
    p = poses(spark, [[(0, 0), (0, 0)], [(3, 4), (1, 0)], [(3, 4), (1, 0)], [(9, 9), (9, 9)]], [[1, 0], [1, 1], [1, 0], [0, 0]])
    got = [r["energy"] for r in signal.motion_energy(p).orderBy("t").collect()]
    assert got == [0, 2.5, 0, 0]  # 5 over the two points seen, though only one was seen before


def test_body_frame_does_not_depend_on_place_and_size(spark):
    rng = np.random.default_rng(1)
    kp = rng.normal(size=(3, 5, 2))
    score = np.ones((3, 5))
    score[2, 1] = 0
    one, two = (geometry.body_frame(poses(spark, k, score), 0, 1).orderBy("t").collect() for k in (kp, kp * 7 + 3))
    for a, b in zip(one, two, strict=True):
        np.testing.assert_allclose(a["kp"], b["kp"], atol=1e-9)
        assert a["valid"] == b["valid"]
    assert not one[2]["valid"] and not np.array(one[2]["kp"]).any() and not any(one[2]["score"])


def test_velocity_over_gaps(spark):
    p = poses(spark, [[(1, 1)], [(2, 1)], [(5, 5)], [(4, 1)], [(6, 2)]], [[1], [1], [0], [1], [1]])
    df = geometry.velocity(geometry.zero_absent(p, geometry.confidence("graded")))
    assert [tuple(r["vel"][0]) for r in df.orderBy("t").collect()] == [(0, 0), (1, 0), (0, 0), (0, 0), (2, 1)]


def test_layout_and_options():
    assert geometry.layout({"body": 3, "hand": 2}, 5) == [("body", 0, 15), ("hand", 15, 25)]
    with pytest.raises(ValueError):
        geometry.Pipeline(confidence="soft")
    with pytest.raises(ValueError):
        geometry.Pipeline(dropped=("legs",))
    assert "confidence=graded" in geometry.Pipeline().describe()


def test_fixed_length_and_standardizer(spark):
    rows = [(k, t, [float(t), 1.0]) for k, n in ((0, 7), (1, 2)) for t in range(n)]
    f = spark.createDataFrame(rows, "series long, t int, feat array<double>")
    got = sorted((r["series"], r["t"], r["feat"], r["padded"]) for r in geometry.fixed_length(f, 4).collect())
    assert got == [(0, t, [float(t + 1), 1.0], False) for t in range(4)] + [(1, 0, [0.0, 1.0], False), (1, 1, [1.0, 1.0], False), (1, 2, [0.0, 0.0], True), (1, 3, [0.0, 0.0], True)]
    fit = geometry.fit_standardizer(f)
    assert {r["col"]: r["std"] for r in fit.collect()}[1] == 1.0
    out = np.array([r["feat"] for r in geometry.standardize(f, fit).collect()])
    assert out.mean(axis=0) == pytest.approx([0, 0]) and out.std(axis=0)[0] == pytest.approx(1)


def test_source_comparison_with_a_short_series(spark, sf, tmp_path):
    """The last series has six frames, its neighbour ten: as in the SQL, the six count."""
    from seqloom.plans.all import QUERIES, SQL
    from tests.oracle import connect, of_spark, of_sql

    spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 36").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert of_spark(QUERIES["t14_source_comparison"](spark, str(tmp_path))) == of_sql(connect(str(tmp_path)), SQL["t14_source_comparison"])
