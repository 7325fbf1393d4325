import math

import numpy as np
import pytest

from seqloom.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>, rank int, place string, query int, label int"


def brute(rows, k=5, every=50):
    """The nearest of each query row, in plain Python."""
    usable = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for qi, q in usable:
        if qi % every:
            continue
        scored = []
        for ci, c in usable:
            if ci != qi and len(c) == len(q):
                a, b = np.array(q) / max(map(abs, q)), np.array(c) / max(map(abs, c))
                scored.append((-float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())), ci))
        out += [(qi, rank, ci, round(-s, 9)) for rank, (s, ci) in enumerate(sorted((round(s, 12), ci) for s, ci in scored)[:k], 1)]
    return sorted(out)


def found(spark, rows, kind="double"):
    df = spark.createDataFrame([(i, v, 1, "p", 2, 3) for i, v in rows], SCHEMA.replace("double", kind)).repartition(3)
    vectors = neighbours.usable(df, "vec_id", "embedding")
    got = neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((r[0], r[1], r[2], round(r[3], 9)) for r in got.collect())


def random_rows(rng, n=400, dim=16):
    return [(i, rng.normal(size=dim).tolist()) for i in range(n)]


@pytest.mark.parametrize("sizes", [(1024, 2048, 1 << 20, 64), (7, 3, 40, 5)])
def test_equals_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("ROWS", "QUERIES", "CELL", "CELLS"), sizes, strict=True):
        monkeypatch.setattr(neighbours, name, value)
    monkeypatch.setattr(neighbours, "EXACT", 5)
    rows = random_rows(np.random.default_rng(0))
    assert found(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    rng = np.random.default_rng(1)
    rows = random_rows(rng, 120, 6) + [(i, rng.normal(size=3).tolist()) for i in range(200, 204)]  # few of another length
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None] + [0.0] * 4), (304, [math.nan] * 6), (305, [math.inf] + [1.0] * 5), (None, [1.0] * 6), (350, [1e-200] * 6), (351, [1e200] * 6), (400, [1.0])]
    rows += [rows[7], rows[50]]  # repeated rows: a candidate and a query
    assert found(spark, rows) == brute(rows)


def test_ties_and_a_vector_shared_by_most_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 16)
    hot = [1.0, -2.0, 0.5, 4.0]
    rng = np.random.default_rng(2)
    rows = [(i, hot if i % 3 else [-x for x in hot]) for i in range(200)] + [(i, rng.normal(size=4).tolist()) for i in range(200, 300)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(50, hot)] * 20 + [(i, hot) for i in range(51, 60)]) == brute([(50, hot)] * 20 + [(i, hot) for i in range(51, 60)])


def test_bounds_hold_and_few_pairs_are_computed_twice():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 64))
    codes, scales, errors = neighbours.quantised(v)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    close = (codes.astype(float) @ codes.T.astype(float)) * scales[:, None] * scales
    bound = errors[:, None] + (1 + errors[:, None]) * errors + neighbours.SLACK
    assert (np.abs(unit @ unit.T - close) <= bound).all()


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(50, [1.0, 2.0])]) == []
