"""Sequence matching against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import heads
from seqloom.operators import match as op


def plain_dtw(a, b, band=None):
    n, m = len(a), len(b)
    if not n or not m:
        return float("inf")
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, n + 1):
        lo, hi = (1, m) if band is None else (max(1, int(i * (m / n) - band)), min(m, int(i * (m / n) + band) + 1))
        for j in range(lo, hi + 1):
            d[i, j] = np.linalg.norm(a[i - 1] - b[j - 1]) + min(d[i - 1, j], d[i - 1, j - 1], d[i, j - 1])
    return d[n, m] / (n + m)


@pytest.fixture(scope="module")
def pairs():
    rng = np.random.default_rng(0)
    return [(i, rng.normal(size=(rng.integers(0, 9), 3)), rng.normal(size=(rng.integers(0, 9), 3))) for i in range(40)]


def table(spark, pairs):
    return spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, a, b in pairs], "k long, a array<array<double>>, b array<array<double>>")


@pytest.mark.parametrize("band", [None, 0, 1, 3, 50])
def test_distance(spark, pairs, band):
    got = {r["k"]: r["distance"] for r in op.align(table(spark, pairs), band).collect()}
    for i, a, b in pairs:
        assert got[i] == pytest.approx(plain_dtw(a, b, band), abs=1e-9)


def test_path_is_a_staircase_of_that_cost(spark, pairs):
    for r in op.align(table(spark, pairs), paths=True).collect():
        a, b = pairs[r["k"]][1:]
        path = [(p["i"], p["j"]) for p in r["path"]]
        if not len(a) or not len(b):
            assert path == []
            continue
        assert path[0] == (0, 0) and path[-1] == (len(a) - 1, len(b) - 1)
        assert all((x - u, y - v) in ((0, 1), (1, 0), (1, 1)) for (u, v), (x, y) in zip(path, path[1:], strict=False))
        assert sum(np.linalg.norm(a[i] - b[j]) for i, j in path) / (len(a) + len(b)) == pytest.approx(r["distance"], abs=1e-9)


def test_identities(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(6, 2))
    slow = np.repeat(a, 3, axis=0)
    got = {r["k"]: r["distance"] for r in op.align(table(spark, [(0, a, a), (1, a, slow), (2, slow, a)])).collect()}
    assert got[0] == pytest.approx(0, abs=1e-6) and got[1] == pytest.approx(0, abs=1e-6) and got[1] == pytest.approx(got[2])


def test_scalar_equals_vector(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=rng.integers(0, 12)).tolist(), rng.normal(size=rng.integers(0, 12)).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, a array<double>, b array<double>")
    for r in df.select("k", op.scalar_dtw("a", "b").alias("d")).collect():
        _, a, b = rows[r["k"]]
        assert r["d"] == pytest.approx(plain_dtw(np.array(a).reshape(-1, 1), np.array(b).reshape(-1, 1)), abs=1e-9)


def test_edit_distance_and_error_rate(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 3]), ([], [1]), ([], []), ([1], []), ([5, 5, 6], [5, 6, 6])], "a array<int>, b array<int>")
    got = [tuple(r) for r in df.select(op.edit_distance("a", "b"), op.word_error_rate("a", "b")).collect()]
    assert got == [(1, pytest.approx(1 / 3)), (1, float("inf")), (0, 0.0), (1, 1.0), (1, pytest.approx(1 / 3))]


def test_greedy_decode_keeps_repeats_across_blanks(spark):
    best = [0, 1, 1, 0, 1, 2, 2, 0]
    df = spark.createDataFrame([(1, t, [1.0 if k == b else 0.0 for k in range(3)]) for t, b in enumerate(best)], "series long, t int, p array<double>")
    assert op.greedy_decode(df, F.col("p")).first()["tokens"] == [1, 1, 2]


def test_forced_labels_are_the_best_path():
    rng = np.random.default_rng(3)
    for _ in range(30):
        target = [int(k) for k in rng.integers(1, 4, rng.integers(1, 4))]
        n = len(target) * 2 + int(rng.integers(0, 3))
        logs = np.log(rng.dirichlet(np.ones(4), n))

        def valid(labels):
            """All collapsed labelings of n frames that read the target, as (score, labels)."""
            best = (-np.inf, None)

            def go(t, s, total, out):
                nonlocal best
                if t == n:
                    if s >= len(states) - 2 and total > best[0]:
                        best = (total, out)
                    return
                for u in (s, s + 1, s + 2):
                    if u < len(states) and (u != s + 2 or (states[u] and states[u] != states[s])):
                        go(t + 1, u, total + logs[t, states[u]], [*out, -1 if not states[u] else (u - 1) // 2])

            states = [0] + [x for k in target for x in (k, 0)]
            for s in (0, 1):
                go(1, s, logs[0, states[s]], [-1 if not states[s] else 0])
            return best

        got = op.forced_labels(logs, target)
        states = {-1: 0} | dict(enumerate(target))
        assert sum(logs[t, states[k]] for t, k in enumerate(got)) == pytest.approx(valid(target)[0])


def test_segments(spark):
    paths = spark.createDataFrame([(1, [(0, 0), (1, 0), (2, 1), (3, 2)])], "k long, path array<struct<i: int, j: int>>")
    owner = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 1), (1, 9, 2)], "k long, j int, part int")
    assert sorted(tuple(r) for r in op.segments(paths, owner, ["k"]).collect()) == [(1, 0, 0, 2), (1, 1, 2, 4), (1, 2, None, None)]


def test_every_clip_is_forced_aligned(spark, sf):
    from seqloom.plans import match as plans

    tokens = {r["series"]: r["tokens"] for r in plans._decoded(spark, sf).collect()}
    labels = {r["series"]: r["labels"].split() for r in plans.forced_align(spark, sf).collect()}
    assert labels.keys() == tokens.keys() and max(map(len, tokens.values())) > 5
    for k, t in tokens.items():
        assert sorted({int(x) for x in labels[k]} - {-1}) == list(range(len(t)))
    assert plans.label_segments(spark, sf).count() == sum(map(len, tokens.values()))
    assert op.forced_labels(np.zeros((3, 2)), []) == [-1, -1, -1]
    none = spark.createDataFrame([(1, [-1, -1], 0)], "series long, labels array<int>, parts int")
    assert op.label_segments(none, F.col("parts")).count() == 0


def series_table(spark, n, labels, seed, longest=6):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, labels)), rng.normal(size=(rng.integers(0, longest), 2)).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "series long, label int, seq array<array<double>>")


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_distances_in_blocks(spark, block):
    rows, bank = series_table(spark, 25, 4, 3)
    asked = [r for r in rows if r[0] % 3 == 0]
    seqs = {i: np.array(s, float).reshape(-1, 2) for i, _, s in rows}
    want = {(i, x, j, y): plain_dtw(seqs[i], seqs[j], 1) for i, x, _ in asked for j, y, _ in rows if i != j}
    df = op.distances(bank.where("series % 3 = 0"), bank, band=1, others=True, block=block)
    got = {(r["query"], r["label_q"], r["series"], r["label"]): r["distance"] for r in df.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)
    assert df.columns == ["query", "label_q", "series", "label", "distance"]
    wanted = {(0, 1), (0, 0), (1, 3), (2, 2), (2, 7)}
    targets = spark.createDataFrame(sorted(wanted), "label_q int, label int")
    got = {(r["query"], r["series"]) for r in op.distances(bank.where("series % 3 = 0"), bank, targets=targets, block=block).collect()}
    assert got == {(i, j) for i, x, _ in asked for j, y, _ in rows if (x, y) in wanted}


def test_numbers_and_draws(spark):
    rows = spark.createDataFrame([(i, int(i >= 40)) for i in range(55)], "series long, label int")
    got = [tuple(r) for r in op.numbered(rows, ["label"], "series", 5, piece=7).select("label", "number", "size").collect()]
    assert sorted(got) == [(0, i, 40) for i in range(40)] + [(1, i, 15) for i in range(15)]
    for size, slots in ((10, 3), (3, 3), (100, 8)):
        df = spark.range(200).selectExpr("id", f"explode(sequence(0, {slots - 1})) slot").withColumn("n", op.stratum(F.col("slot"), slots, F.lit(size), F.xxhash64("id", "slot")))
        per = df.groupBy("id").agg(F.countDistinct("n").alias("k"), F.min("n").alias("a"), F.max("n").alias("b")).collect()
        assert all(r["k"] == slots and r["a"] >= 0 and r["b"] < size for r in per)
        assert df.select("n").distinct().count() == size


def test_trials(spark):
    clips = [(i, i % 7, 3 + i % 4) for i in range(90)]
    df = spark.createDataFrame(clips, "series long, label int, length int")
    train = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 4, 4, 9)], "label int")
    got = op.sample_trials(df, train, spark.range(300).withColumnRenamed("id", "trial"), 3, 11).collect()
    known = {c[0]: c for c in clips}
    per: dict = {}
    for r in got:
        assert known[r["series"]] == (r["series"], r["label"], r["length"]) and r["label"] < 5
        per.setdefault(r["trial"], []).append((r["part"], r["label"]))
    assert len(per) == 300 and all(sorted(p for p, _ in x) == [0, 1, 2] and len({y for _, y in x}) == 3 for x in per.values())
    assert {y for x in per.values() for _, y in x} == set(range(5))
    assert len({r["series"] for r in got if r["label"] == 2}) == 13
    with pytest.raises(ValueError):
        op.sample_trials(df, train, spark.range(1).withColumnRenamed("id", "trial"), 6, 11)


def plain_path(a, b):
    n, m = len(a), len(b)
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i, j] = np.linalg.norm(a[i - 1] - b[j - 1]) + min(d[i - 1, j], d[i - 1, j - 1], d[i, j - 1])
    i, j, path = n, m, []
    while i and j:
        path.append((i - 1, j - 1))
        i, j = min(((d[i - 1, j - 1], 0, (i - 1, j - 1)), (d[i - 1, j], 1, (i - 1, j)), (d[i, j - 1], 2, (i, j - 1))))[2]
    return path[::-1]


def test_align_and_grade(spark):
    rng = np.random.default_rng(4)
    attempts = {s: rng.normal(size=(int(rng.integers(10, 20)), 4)).cumsum(axis=0) for s in range(12)}
    parts = {(s, p): (attempts[s][5 * p : 5 * p + 5] + rng.normal(size=(5, 4)) * 0.4)[: int(rng.integers(2, 6))] for s in range(12) for p in range(2)}
    classes, columns = {"shape": ["a", "b", "c"], "repeats": ["False", "True"]}, {"shape": [0, 1], "repeats": [2, 3, 4, 5]}
    weights = {name: rng.normal(size=(len(c), len(columns[name]) + 1)) for name, c in classes.items()}
    model = heads.Model(classes, columns, weights, rng.normal(size=6), rng.uniform(1, 2, size=6))
    wanted = {(s, p, name): (classes[name][(s + p) % len(classes[name])], bool((s + k) % 3)) for s in range(12) for p in range(2) for k, name in enumerate(classes)}
    want = {}
    for s, a in attempts.items():
        b = [(p, x) for p in range(2) for x in parts[s, p]]
        path = plain_path(a, np.array([x for _, x in b]))
        d = plain_dtw(a, np.array([x for _, x in b]))
        for p in range(2):
            mine = [i for i, j in path if b[j][0] == p]
            start, stop = min(mine), max(mine) + 1
            seg = a[start:stop]
            energy = [0.0, *(float(np.linalg.norm(y - x)) for x, y in zip(seg, seg[1:], strict=False))]
            hot = [t for t, e in enumerate(energy) if e > 1.6]
            lo, hi = (hot[0], hot[-1] + 1) if hot else (0, len(seg))
            lo, hi = max(0, lo - 1), min(len(seg), hi + 2)
            cut = seg[lo:hi]
            mean, top = cut.mean(axis=0), cut.max(axis=0)  # columns 0 and 1 are the hands
            feat = [max(mean[0], mean[1]), max(top[0], top[1]), mean[2], mean[3], top[2], top[3]]
            x = (np.array(feat) - model.mean) / model.scale
            for name in classes:
                z = weights[name] @ np.append(x[columns[name]], 1)
                said, sure = classes[name][int(z.argmax())], 1 / np.exp(z - z.max()).sum()
                target, judged = wanted[s, p, name]
                want[s, p, name] = (start + lo, start + hi, pytest.approx(d, abs=1e-7), said, target, pytest.approx(sure, abs=1e-9), said == target if judged else None)
    frames = lambda rows, more="": spark.createDataFrame(rows, "series long, t int, f array<double>" + more)
    attempt = frames([(s, t, x.tolist()) for s, a in attempts.items() for t, x in enumerate(a)])
    reference = frames([(s, t, x.tolist(), p) for s in attempts for t, (p, x) in enumerate((p, x) for p in range(2) for x in parts[s, p])], ", part int")
    targets = spark.createDataFrame([(s, p, name, t, j) for (s, p, name), (t, j) in wanted.items()], "series long, part int, parameter string, target string, judged boolean")
    grade = lambda rows: heads.verdicts(heads.pooled(rows, "f", [0], [1], [2, 3]), model)
    found = op.align_and_grade(attempt, reference, targets, grade, 1.6, preroll=1, settle=2).collect()
    got = {(r["series"], r["part"], r["parameter"]): (r["start"], r["stop"], r["distance"], r["predicted"], r["target"], r["confidence"], r["correct"]) for r in found}
    assert got == want and {w[-1] for w in want.values()} == {True, False, None}


def test_label_segments_and_forced_alignment_by_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(k, np.log(rng.dirichlet(np.ones(4), 6)).tolist(), rng.integers(1, 4, size=int(rng.integers(0, 3))).tolist()) for k in range(20)]
    df = spark.createDataFrame(rows, "series long, probs array<array<double>>, target array<int>")
    labels = op.forced_align(df)
    found = {r["series"]: r["labels"] for r in labels.collect()}
    for k, probs, target in rows:
        best = None
        for path in np.ndindex(*(4,) * 6):
            folded = [c for i, c in enumerate(path) if c and (not i or path[i - 1] != c)]
            if folded == target:
                score = sum(probs[t][c] for t, c in enumerate(path))
                if best is None or score > best[0]:
                    best = (score, path)
        if best is None:
            assert found[k] is None
            continue
        at, want, was = -1, [], 0
        for c in best[1]:
            at += c != 0 and c != was
            want.append(at if c else -1)
            was = c
        assert found[k] == want
    parts = {k: len(t) for k, _, t in rows}
    segments = op.label_segments(labels.join(df.selectExpr("series", "size(target) parts"), "series"), F.col("parts"))
    got = {(r["series"], r["part"]): (r["start"], r["stop"]) for r in segments.collect()}
    assert got == {(k, p): (min(own), max(own) + 1) if (own := [t for t, x in enumerate(found[k] or []) if x == p]) else (0, 0) for k in parts for p in range(parts[k])}


@pytest.mark.parametrize("band", [None, 2.0])
@pytest.mark.parametrize("others", [False, True])
def test_nearest_with_bounds_equals_all_pairs(spark, band, others):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(90):
        centre = rng.normal(size=3) * 6 if k % 3 else np.zeros(3)
        rows.append((k, k % 4, [(centre + x).tolist() for x in rng.normal(size=(int(rng.integers(0 if k % 17 == 0 else 1, 14)), 3)).cumsum(axis=0) * 0.3]))
    rows += [(90, 1, rows[5][2]), (91, 2, rows[5][2])]  # equal series
    df = spark.createDataFrame(rows, "series long, label int, seq array<array<double>>")
    queries = df.where("series % 3 = 0 or series > 88")
    for targets in (None, spark.createDataFrame([(a, b) for a in range(4) for b in (a, (a + 1) % 4)], "label_q int, label int")):
        every = op.per_label(op.distances(queries, df, band, targets, others, block=20))
        want = {(r["query"], r["label"]): r["distance"] for r in every.collect()}
        found = op.nearest(queries, df, band, targets, others, block=20).collect()
        got = {(r["query"], r["label"]): r["distance"] for r in found}
        assert got.keys() == want.keys() and len(found) == len(want)
        for k, d in want.items():
            assert got[k] == d or abs(got[k] - d) < 1e-9
        met, computed = sum(r["met"] for r in found), sum(r["computed"] for r in found)
        assert met == op.distances(queries, df, band, targets, others, block=20).count()
        assert computed < 0.8 * met
    mean = {(r["query"], r["label"]): (r["nearest"], r["mean"]) for r in op.summaries(df.where("series between 1 and 16"), df.where("size(seq) > 0"), block=20).collect()}
    plain = op.distances(df.where("series between 1 and 16"), df.where("size(seq) > 0"), block=20).groupBy("query", "label").agg(F.min("distance").alias("a"), F.avg("distance").alias("b"))
    assert {k: pytest.approx(v) for k, v in mean.items()} == {(r["query"], r["label"]): (r["a"], r["b"]) for r in plain.collect()}


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame([(1, 1, [[0.0]])], "series long, label int, seq array<array<double>>")
    assert op.nearest(df, df, others=True).count() == 0 and op.nearest(df.limit(0), df).count() == 0 and op.nearest(df, df.limit(0)).count() == 0


def test_frames_of_pairs_are_held_in_bounded_parts():
    """What a task holds at once goes by the numbers of the frames, too, not by the cells of the costs alone."""
    import tracemalloc

    import numpy as np

    from seqloom.operators.match import _Nearest

    rng = np.random.default_rng(0)
    some = _Nearest([rng.normal(size=(10, 64)) for _ in range(200)], None)
    i, j = np.repeat(np.arange(100), 100), np.tile(np.arange(100, 200), 100)
    tracemalloc.start()
    cost = some.refined(i, j, np.full(len(i), np.inf))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and np.isfinite(cost).all()
