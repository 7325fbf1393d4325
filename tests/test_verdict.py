"""Verdict operators that SQL can't express, against plain Python."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import heads
from seqloom.operators import verdict as op


def field(number, value):
    """One field of a protocol buffer."""

    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def onnx_product(weights):
    """The bytes of a model that multiplies a matrix of rows by ``weights``: y = x w."""
    n, m = weights.shape
    shape = lambda *dims: b"".join(field(1, field(1, d) if isinstance(d, int) else field(2, d)) for d in dims)
    info = lambda name, *dims: field(1, name) + field(2, field(1, field(1, 1) + field(2, shape(*dims))))
    node = field(1, "x") + field(1, "w") + field(2, "y") + field(4, "MatMul")
    held = field(1, n) + field(1, m) + field(2, 1) + field(8, "w") + field(9, struct.pack(f"<{n * m}f", *weights.reshape(-1)))
    graph = field(1, node) + field(2, "g") + field(5, held) + field(11, info("x", "rows", n)) + field(12, info("y", "rows", m))
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13))


def test_batches_are_scored_by_an_onnx_model(spark):
    rng = np.random.default_rng(0)
    w, x = rng.normal(size=(5, 3)), rng.normal(size=(200, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, feat array<double>").repartition(3)
    for model in (onnx_product(w), lambda m, w=w: m @ w):
        got = {r["id"]: r["scores"] for r in op.score_batches(rows, "feat", model).collect()}
        assert all(got[i] == pytest.approx((x[i] @ w).tolist(), abs=1e-4) for i in range(200)) and len(got) == 200


def test_self_is_excluded(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(30, 4))
    v[7] = v[11]
    rows = spark.createDataFrame([(i, i % 3 if i != 29 else 9, x.tolist()) for i, x in enumerate(v)], "vec_id long, label int, embedding array<double>")
    for block in (4, 4096):
        got = {(r["query"], r["label"]): r["distance"] for r in op.nearest_by_label(rows, rows, block, others=True).collect()}
        want = {}
        for i in range(30):
            for j in range(30):
                if i != j:
                    k = (i, j % 3 if j != 29 else 9)
                    want[k] = min(want.get(k, 1e9), float(np.linalg.norm(v[i] - v[j])))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_batches_of_labels_and_members(spark):
    sizes = {0: 30, 1: 9, 2: 3, 3: 12, 4: 1}
    rows = spark.createDataFrame([(100 * label + i, label) for label, n in sizes.items() for i in range(n)], "vec_id long, label int")
    got = op.pk_batches(rows, spark.range(60).withColumnRenamed("id", "batch"), 3, 4, 2).collect()
    batches = {}
    for r in got:
        assert r["vec_id"] // 100 == r["label"]
        batches.setdefault(r["batch"], {}).setdefault(r["label"], []).append(r)
    assert len(batches) == 60 and all(len(b) == 3 for b in batches.values())
    for b in batches.values():
        for label, rs in b.items():
            assert sorted(r["slot"] for r in rs) == [0, 1, 2, 3]
            assert len({r["vec_id"] for r in rs}) == min(4, sizes[label])
    assert {x for b in batches.values() for x in b} == set(sizes)
    with pytest.raises(ValueError):
        op.pk_batches(rows, spark.range(1).withColumnRenamed("id", "batch"), 6, 4, 2)


def test_heads_are_fitted_together_and_see_their_own_columns_only(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    two = ["low", "mid", "high"]
    rows = [(i, v.tolist(), None if i % 10 == 0 else str(bool(v[0] > 0)), two[int(v[2] + v[3] > 0.5) + int(v[2] + v[3] > -0.5)]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, feat array<double>, one string, two string")
    model = heads.fit(df.where("id < 200").repartition(3), {"one": [0, 1], "two": [2, 3]})
    told = lambda rows: {(r["id"], r["parameter"]): (r["predicted"], r["confidence"]) for r in heads.verdicts(rows.select("id", "feat"), model).collect()}
    test = df.where("id >= 200")
    said = told(test)
    truth = {(r["id"], name): r[name] for r in test.collect() for name in ("one", "two") if r[name] is not None}
    right = {name: np.mean([said[k][0] == v for k, v in truth.items() if k[1] == name]) for name in ("one", "two")}
    assert right["one"] > 0.95 and right["two"] > 0.85
    other = told(test.withColumn("feat", F.expr("array(feat[0], feat[1], -9D, 9D, 5D)")))
    assert all(other[i, "one"] == said[i, "one"] for i, _ in said) and any(other[i, "two"][0] != said[i, "two"][0] for i, _ in said)
    # the model's own numbers give the same answer, and the fit is where the loss is flat
    logs = model.log_probabilities(x[200:])
    assert all(said[200 + k, name][0] == model.classes[name][int(logs[name][k].argmax())] for k in range(100) for name in logs)
    known = [i for i in range(200) if i % 10]
    p = np.exp(model.log_probabilities(x[known])["one"])
    z = np.concatenate([((x[known] - model.mean) / model.scale)[:, :2], np.ones((len(known), 1))], axis=1)
    y = np.array([[rows[i][2] == c for c in model.classes["one"]] for i in known], float)
    assert np.abs((p - y).T @ z / len(known) + 1e-3 * model.weights["one"]).max() < 5e-3
    assert told(test.withColumn("feat", F.lit(None).cast("array<double>")))[200, "one"] == (None, None)


def test_pooled_features_merge_the_hands(spark):
    rng = np.random.default_rng(5)
    clips = {s: rng.normal(size=(s + 1, 5)) for s in range(4)}
    df = spark.createDataFrame([(s, t, f.tolist()) for s, c in clips.items() for t, f in enumerate(c)], "series long, t int, f array<double>")
    for r in heads.pooled(df, "f", [0, 1], [2, 3], [4]).collect():
        mean, top = clips[r["series"]].mean(axis=0), clips[r["series"]].max(axis=0)
        assert r["feat"] == pytest.approx([*np.maximum(mean[:2], mean[2:4]), *np.maximum(top[:2], top[2:4]), mean[4], top[4]])


def test_registered_heads_beat_the_majority(spark, sf):
    from seqloom.plans.all import QUERIES

    found = QUERIES["e14_heads"](spark, sf).collect()
    assert len(found) == 5 and all(r["accuracy"] > r["majority"] for r in found)
