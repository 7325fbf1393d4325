"""Folds over long histories, and the package on workers that were started elsewhere."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from seqloom.operators import learner
from seqloom.operators.fold import affine, fold

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("parts, piece", [(1, 65_536), (7, 10), (3, None)])
def test_affine_steps_join_to_the_plain_loop(spark, parts, piece, monkeypatch):
    rng = random.Random(parts)
    if piece:
        monkeypatch.setattr(learner, "PIECE", piece)
    rows = [(k if k % 3 else 0, f"i{k % 2}", t, rng.random() < 0.6) for k in range(5) for t in range(rng.randint(1, 200))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "learner long, item string, ord long, correct boolean").repartition(parts)
    if piece is None:
        df = df.withColumn("ord", F.col("ord") / 2)  # no whole numbers: dealt by ranges
    got = {(r["learner"], r["item"]): (r["mastery"], r["attempts"]) for r in learner.mastery(df, ["learner", "item"]).collect()}
    want = {}
    for who, item, _, correct in sorted(rows):
        m, n = want.get((who, item), (0.5, 0))
        want[who, item] = (m + 0.3 * (float(correct) - m), n + 1)
    assert got.keys() == want.keys()
    for k, (m, n) in want.items():
        assert got[k][1] == n and abs(got[k][0] - m) < 1e-9


def test_one_key_is_dealt_to_many_tasks_and_never_gathered(spark):
    df = spark.range(200_000, numPartitions=8).select(F.lit(1).alias("k"), F.col("id").alias("ord"), (F.col("id") % 3 == 0).cast("double").alias("x"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = affine(df, ["k"], ["ord"], "x", 0.7, 0.5)
        plan = made._jdf.queryExecution().toString()
        assert "collect_list" not in plan
        m = 0.5
        for i in range(199_900, 200_000):
            m = m + 0.3 * ((1.0 if i % 3 == 0 else 0.0) - m)
        r = made.first()
        assert r["n"] == 200_000 and abs(r["x"] - m) < 1e-9
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_long_history_passes_in_batches(spark):
    df = spark.range(300_000).select((F.col("id") % 2).alias("learner"), F.lit("i").alias("item"), F.col("id").alias("ord"), (F.col("id") % 11 != 5).alias("good"))
    got = {r["learner"]: (r["repetitions"], r["interval"], round(r["ease"], 9)) for r in learner.spacing(df).collect()}
    for who in (0, 1):
        s = (0, 1, learner.EASE)
        for i in range(who, 300_000, 2):
            s = learner.advance_spacing(s, i % 11 != 5)
        assert got[who] == (s[0], s[1], round(s[2], 9))


def test_results_for_each_row_and_null_keys(spark):
    df = spark.createDataFrame([(None, 2, 5), (None, 1, 3), ("a", 1, 1)], "k string, o int, v int")
    out = fold(df, ["k"], ["o"], ["v"], lambda: 0, lambda s, v: (s + v, (s + v,)), None, "k string, total int", each=True)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(None, 3), (None, 8), ("a", 1)]))
    empty = fold(df.limit(0), ["k"], ["o"], ["v"], lambda: 0, lambda s, v: s + v, lambda s: [(s,)], "k string, total int")
    assert empty.count() == 0


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from seqloom.plans.all import QUERIES
for name in ("d2_dtw", "d12_align_and_grade", "io5_clip_scan", "io8_binary_attempts", "s1_capture_stream", "m1_mastery"):
    print(name, QUERIES[name](spark, {sf!r}).count())
"""


def test_workers_find_the_package_from_another_folder(tmp_path, sf):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "job.py"
    script.write_text(SCRIPT.format(root=ROOT, shared=str(tmp_path / "shared"), sf=sf))
    done = subprocess.run([sys.executable, "-I", str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    counts = dict(line.split() for line in done.stdout.splitlines() if len(line.split()) == 2)
    assert len(counts) == 6 and all(int(n) for n in counts.values()), done.stderr[-2000:]
