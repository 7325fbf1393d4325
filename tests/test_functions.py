"""SQL functions give what the operators give."""

import pytest

from seqloom.functions import sql
from seqloom.operators import match
from seqloom.sources import files


def test_scalar_functions(spark):
    sql.register(spark)
    df = spark.createDataFrame([([1.0, 2.0, 5.0], [1.0, 5.0]), ([], [1.0])], "a array<double>, b array<double>")
    df.createOrReplaceTempView("pairs")
    got = [r[0] for r in spark.sql("SELECT dtw(a, b) FROM pairs").collect()]
    assert got == [r[0] for r in df.select(match.scalar_dtw("a", "b")).collect()]
    r = spark.sql("SELECT edits(array('a', 'b', 'c'), array('a', 'c')), best_class(array(1D, 3D, 3D)), confidence_of_best(array(0D, 0D))").first()
    assert tuple(r) == (1, 1, 0.5)


def test_table_functions(spark):
    sql.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM dtw_path(array(array(0D), array(1D)), array(array(0D), array(0D), array(1D)))").collect()] == [(0, 0), (0, 1), (1, 2)]
    assert [tuple(r) for r in spark.sql("SELECT * FROM forced_labels(array(array(0D, -9D), array(-9D, 0D), array(0D, -9D)), array(1))").collect()] == [(0, -1), (1, 0), (2, -1)]
    blob = files.pack_attempt([0.5], [[[1, 2]]], [[1]], [2])
    spark.createDataFrame([(blob, '{"format": "attempt/1", "n_frames": 1, "n_keypoints": 1}')], "content binary, meta string").createOrReplaceTempView("blobs")
    assert [tuple(r) for r in spark.sql("SELECT t, time, state FROM blobs, LATERAL attempt_frames(content, meta)").collect()] == [(0, 0.5, pytest.approx(2))]
