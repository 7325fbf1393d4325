"""Mastery, spacing and scheduling against plain folds."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import learner as op


def history(seed, n=400):
    rng = random.Random(seed)
    return [(rng.randint(0, 3), rng.choice("abc"), i, rng.choice(["p", "q"]), rng.choice([True, False, None])) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "learner long, item string, ord long, parameter string, correct boolean")


def test_mastery(spark):
    rows = history(1)
    want, tries = {}, {}
    for who, item, _, p, ok in rows:
        if ok is not None:
            k = (who, item, p)
            want[k] = want.get(k, 0.5) + 0.3 * (ok - want.get(k, 0.5))
            tries[k] = tries.get(k, 0) + 1
    got = {(r["learner"], r["item"], r["parameter"]): (r["mastery"], r["attempts"]) for r in op.mastery(table(spark, rows), ["learner", "item", "parameter"]).collect()}
    assert got == {k: (pytest.approx(v), tries[k]) for k, v in want.items()}


def test_spacing(spark):
    rows = history(2)
    want = {}
    for who, item, _, _, ok in rows:
        reps, interval, ease = want.get((who, item), (0, 1, 2.5))
        if ok is not False:
            reps += 1
            interval = {1: 1, 2: 3}.get(reps) or min(40, round(interval * ease))
            ease = min(3.0, ease + 0.05)
        else:
            reps, interval, ease = 0, 1, max(1.3, ease - 0.2)
        want[who, item] = (reps, interval, ease)
    got = {(r["learner"], r["item"]): (r["repetitions"], r["interval"], r["ease"]) for r in op.spacing(op.passes(table(spark, rows))).collect()}
    assert got == {k: (v[0], v[1], pytest.approx(v[2])) for k, v in want.items()}


def test_half_is_rounded_to_even(spark):
    # 3 * 2.6 = 7.8, then 8 * 2.65 = 21.2; a miss in between lowers the ease to 2.5 with interval 1
    good = spark.createDataFrame([(1, "a", i, "p", True) for i in range(4)], "learner long, item string, ord long, parameter string, correct boolean")
    assert op.spacing(op.passes(good)).first()["interval"] == 21


def pool(spark, rows):
    return spark.createDataFrame(rows, "learner long, item string, clock long, is_due boolean, mastery double")


def contrast(spark):
    return spark.createDataFrame([("a", "p", "b"), ("b", "p", "a")], "item string, field string, partner string")


def test_contrast_comes_first(spark):
    last = spark.createDataFrame([(1, "a", "p"), (2, "a", "q"), (3, "a", None)], "learner long, item string, field string")
    rows = [(k, i, 9, i == "c", 0.2) for k in (1, 2, 3) for i in "abc"]
    got = {r["learner"]: (r["item"], r["reason"]) for r in op.next_item(pool(spark, rows), last, contrast(spark), 1).collect()}
    assert got[1] == ("b", "contrast") and got[2] == got[3] == ("c", "drawn")


def test_draws_follow_the_weights(spark):
    rows = [(k, i, 1, False, m) for k in range(4000) for i, m in (("c", 0.05), ("d", 0.55))]  # nothing is due: all are drawn from
    last = spark.createDataFrame([], "learner long, item string, field string")
    got = op.next_item(pool(spark, rows), last, contrast(spark), 1).groupBy("item").agg(F.count("*").alias("n")).collect()
    share = {r["item"]: r["n"] / 4000 for r in got}
    assert share["c"] == pytest.approx(1.0 / 1.5, abs=0.04)


def test_mastered_items_are_redirected_half_of_the_time(spark):
    rows = [(k, i, 1, i == "a", 0.9) for k in range(2000) for i in "ab"]
    last = spark.createDataFrame([], "learner long, item string, field string")
    n = op.next_item(pool(spark, rows), last, contrast(spark), 2).where("reason = 'redirect' and item = 'b'").count()
    assert 800 < n < 1200


def test_due(spark):
    passed = spark.createDataFrame([(1, "a", 1, True), (1, "b", 2, True), (1, "a", 3, True)], "learner long, item string, ord long, good boolean")
    items = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "learner long, item string")
    got = {(r["learner"], r["item"]): (r["clock"], r["due_at"], r["is_due"]) for r in op.due(passed, op.spacing(passed), items).collect()}
    assert got == {(1, "a"): (3, 6, False), (1, "b"): (3, 3, True), (1, "c"): (3, None, True), (2, "a"): (0, None, True)}
