"""The capture machine: constant state against lists of frames, batch against stream, and scripted series."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import learner
from seqloom.streaming import admission, feed, live_learner
from seqloom.streaming import capture as op


def with_lists(energies, limits):
    """The rule with the buffer itself: the buffered frames' energies are seen anew, the first counts 0."""
    buffer, state, out = [], op.IDLE, []
    for t in range(len(energies)):
        if state != op.SETTLED:
            buffer.append(t)
            seen = [0.0] + [energies[i] for i in buffer[1:]]
            if len(seen) >= 2:
                if state == op.IDLE:
                    if max(seen[-3:]) > limits.threshold:
                        state = op.ACTIVE
                    else:
                        buffer = buffer[-limits.preroll :]
                elif len(buffer) >= limits.longest:
                    state = op.SETTLED
                elif len(seen) >= limits.settle and max(seen[-limits.settle :]) <= limits.threshold:
                    state = op.SETTLED
        out.append((t, state, buffer[0], len(buffer)))
    return out


def series(n, seed):
    rng = random.Random(seed)
    return [[round(rng.choice([0, 0.5, 1, 2]) * rng.random(), 3) for _ in range(rng.randint(1, 80))] for _ in range(n)]


@pytest.mark.parametrize("limits", [op.Limits(0.6), op.Limits(0.6, 3, 3, 12), op.Limits(0.9, 12, 5, 40), op.Limits(0.6, 4, 0, 30)])
def test_constant_state_equals_lists(limits):
    for energies in series(300, 1):
        m, got = op.FRESH, []
        for t, e in enumerate(energies):
            m = op.advance(m, t, e, limits)
            got.append((t, m[0], m[1], m[2]))
        assert got == with_lists(energies, limits)


def test_short_preroll_is_refused():
    with pytest.raises(ValueError):
        op.Limits(0.5, preroll=2)


def timed(frames, column="t"):
    """Frames with an event time: a second for each number."""
    return frames.withColumn("at", F.timestamp_seconds(F.lit(1_000_000) + (F.col(column) if isinstance(column, str) else column)))


def in_files(spark, frames, folder, parts):
    """The rows as a stream that takes a file to a trigger; ``parts`` are conditions."""
    for condition in parts:
        frames.where(condition).coalesce(1).write.mode("append").parquet(folder)
    return feed.of_table(spark, folder, files=1)


def told(df):
    return sorted((r["series"], r["t"], r["state"], r["first"], r["n"]) for r in df.collect())


def test_batch_fold_and_stream_agree(spark, tmp_path):
    limits = op.Limits(0.6, 4, 5, 25)
    found = series(25, 2)
    rows = [(k, t, e) for k, energies in enumerate(found) for t, e in enumerate(energies)]
    frames = spark.createDataFrame(rows, "series long, t int, energy double")
    want = sorted((k, *r) for k, energies in enumerate(found) for r in with_lists(energies, limits))
    assert told(op.states(frames, limits)) == want
    # files out of order, frames dealt at random, in one trigger or several, and with repeated frames
    parts = ["t >= 50", "t < 50 and pmod(xxhash64(t), 2) = 0", "t < 50 and pmod(xxhash64(t), 2) = 1", "t < 5"]
    stream = in_files(spark, timed(frames), str(tmp_path / "in"), parts)
    assert told(feed.replayed(stream, lambda s: op.stream_states(s, limits), "100 seconds", at_once=False)) == want
    one = feed.of_table(spark, str(tmp_path / "in"))
    assert told(feed.replayed(one, lambda s: op.stream_states(s, limits))) == want
    replayed = {r["series"]: (r["state"], r["start"], r["stop"], r["settle_index"]) for r in op.replay(frames, [4], limits).collect()}
    for k, energies in enumerate(found):
        last = with_lists(energies, limits)
        at = next((t for t, s, _, _ in last if s == op.SETTLED), None)
        first = last[-1][2]
        assert replayed[k] == (last[-1][1], None if at is None else first, None if at is None else at + 1, at)


def test_long_frame_numbers_and_a_table_in_many_files(spark, tmp_path):
    big = 1 << 60
    frames = timed(spark.range(60).selectExpr("id % 3 AS series", f"id + {big} AS t", "double(id % 7 = 3) AS energy"), F.col("t") - big)
    frames.repartition(5).write.parquet(str(tmp_path / "in"))
    got = feed.replayed(feed.of_table(spark, str(tmp_path / "in")), lambda s: op.stream_states(s, op.Limits(0.5)))
    assert sorted(r["t"] for r in got.collect()) == [big + k for k in range(60)]
    assert told(got) == told(op.states(frames, op.Limits(0.5)))


def test_registered_streams_read_a_folder_of_files(spark, sf, tmp_path):
    from seqloom.plans.all import QUERIES

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("s1_capture_stream", "s9_newest"):
        rows = lambda folder, name=name: sorted(map(str, QUERIES[name](spark, folder).collect()))
        assert rows(str(tmp_path)) == rows(sf) != []


def test_a_stream_without_a_row(spark, tmp_path):
    frames = timed(spark.createDataFrame([], "series long, t long, energy double, active boolean"))
    frames.write.parquet(str(tmp_path / "in"))
    stream = feed.of_table(spark, str(tmp_path / "in"))
    assert feed.replayed(stream, lambda s: op.stream_states(s, op.Limits(1.0))).count() == 0
    got = feed.each_trigger(spark, stream, lambda df: op.newest(df, ["series"], "t", "energy"))
    assert got.count() == 0 and got.columns == ["series", "energy", "skipped", "trigger"]


def grade_by_mean(rows):
    return rows.select("series", (F.aggregate("f", F.lit(0.0), lambda a, x: a + x) / F.col("n")).alias("mean"))


def test_verdicts_after_each_trigger_equal_grading_what_has_come(spark, tmp_path):
    limits, least = op.Limits(0.6, 4, 5, 25), 8
    found = [s for s in series(60, 4) if len(s) > 20][:12]
    rows = [(k, t, e, [float(t), e]) for k, energies in enumerate(found) for t, e in enumerate(energies)]
    frames = timed(spark.createDataFrame(rows, "series long, t long, energy double, f array<double>"))
    folder, log = str(tmp_path / "in"), str(tmp_path / "log")
    frames.limit(0).write.parquet(folder)
    made = op.stream_captures(spark.readStream.schema(frames.schema).parquet(folder).withWatermark("at", "0 seconds"), limits)
    step = lambda df, number: op.graded(df, grade_by_mean, least).write.mode("overwrite").parquet(f"{log}/trigger={number}")
    for low, high in ((0, 15), (15, 33), (33, 90)):
        frames.where(f"t >= {low} and t < {high}").write.mode("append").parquet(folder)
        feed._run(made, str(tmp_path / "job"), step, "append")  # restarted each time
        newest = frames.where(f"t < {high}").agg(F.max("t")).first()[0]
        want = {}
        for k, energies in enumerate(found):
            seen = [e for t, e in enumerate(energies) if t <= newest]
            if seen:
                _, state, first, n = with_lists(seen, limits)[-1]
                if state != op.IDLE and n >= least:
                    want[k] = (n, round(sum(x for t in range(first, first + n) for x in (float(t), energies[t])) / n, 9), False)
        got = {r["series"]: (r["n"], round(r["mean"], 9), r["stale"]) for r in op.verdicts(spark.read.parquet(log)).collect()}
        assert got == want
    assert want


def test_a_reset_makes_a_verdict_stale_until_the_next(spark, tmp_path):
    limits, least = op.Limits(0.5, 3, 3, 20), 4
    e = [0.0, 0.0, 1.0, 1.0, 1.0, 1.0]
    rows = [(1, t, x, [x], False) for t, x in enumerate(e)] + [(1, 6, None, None, True)] + [(1, 7 + t, x, [2 * x], False) for t, x in enumerate(e)] + [(2, 0, 0.0, [0.0], False)]
    frames = timed(spark.createDataFrame(rows, "series long, t long, energy double, f array<double>, reset boolean"))
    got = []
    for high in (6, 8, 30):
        log = str(tmp_path / f"log{high}")
        parts = [f"t < {min(high, 6)}", f"t >= 6 and t < {high}"]
        stream = in_files(spark, frames, str(tmp_path / f"in{high}"), parts)
        step = lambda df, number, log=log: op.graded(df, grade_by_mean, least).write.mode("overwrite").parquet(f"{log}/trigger={number}")
        feed.replayed(stream, lambda s: op.stream_captures(s, limits), step=step, at_once=False)
        got.append([(r["series"], round(r["mean"], 6), r["stale"]) for r in op.verdicts(spark.read.parquet(log)).collect()])
    assert got == [[(1, round(4 / 6, 6), False)], [(1, round(4 / 6, 6), True)], [(1, round(8 / 6, 6), False)]] or got == [[(1, round(4 / 6, 6), False)], [(1, 0.8, True)], [(1, round(8 / 6, 6), False)]]


def test_degraded_mode():
    limits = op.Limits(1.0, 3, 4, 6)
    m, got = op.FRESH, []
    for t, e in enumerate([0.0, 0.1, None, 5.0, 5.0, 5.0, 5.0, 5.0]):
        m = op.advance(m, t, e, limits)
        got.append((m[0], m[2]))
    assert got == [(0, 1), (0, 2), (0, 3), (1, 4), (1, 5), (1, 6), (1, 6), (1, 6)]


def admitted(calls, daily, most, window):
    day, recent, out = {}, {}, set()
    for call, client, time, d in sorted(calls, key=lambda c: (c[2], c[0])):
        if day.get(d, 0) >= daily:
            continue
        q = [x for x in recent.get(client, []) if time - x <= window]
        recent[client] = q
        if len(q) >= most:
            continue
        q.append(time)
        day[d] = day.get(d, 0) + 1
        out.add(call)
    return out


def some_calls(spark, n=400):
    rng = random.Random(5)
    calls = [(i, rng.randint(0, 5), float(rng.randint(0, 4000)), None) for i in range(n)]
    calls = [(i, c, t, f"d{int(t // 1000)}") for i, c, t, _ in calls]
    return calls, spark.createDataFrame(calls, "call long, client long, time double, day string")


@pytest.mark.parametrize("limits", [(1000, 3, 60.0), (20, 3, 100.0), (5, 100, 10.0), (15, 2, 900.0)])
def test_admission_equals_one_pass(spark, limits):
    calls, df = some_calls(spark)
    got = {r["call"] for r in admission.admit(df, *limits).where("admitted").collect()}
    assert got == admitted(calls, *limits)


def test_admission_of_a_stream_over_triggers_and_a_restart(spark, tmp_path):
    calls, df = some_calls(spark, 250)
    limits = (15, 2, 900.0)
    frames = df.withColumn("at", F.timestamp_seconds(F.col("time") + 1000))
    folder = str(tmp_path / "in")
    frames.limit(0).write.parquet(folder)
    whole = feed.Ending(spark.readStream.schema(frames.schema).parquet(folder))
    made = admission.stream(whole.rows.withWatermark("at", "1800 seconds"))
    for part in ("time >= 300 and time < 1700", "time < 300", "time >= 1700"):  # out of order, within the delay
        frames.where(part).write.mode("append").parquet(folder)
        feed._run(made, str(tmp_path / "job"), admission.Gate(spark, str(tmp_path / "gate"), *limits).step, "append")  # a new gate each time
    whole.end()
    gate = admission.Gate(spark, str(tmp_path / "gate"), *limits)
    feed._run(made, str(tmp_path / "job"), gate.step, "append")
    found = gate.told().collect()
    assert len(found) == len(calls)
    assert {r["call"] for r in found if r["admitted"]} == admitted(calls, *limits)


def test_the_learner_state_after_each_trigger_equals_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for k in range(120):
        for p in rng.sample(["p0", "p1", "p2"], rng.randint(1, 3)):
            rows.append((k, rng.randint(0, 2) if p == "p0" else k % 3, f"i{k % 4}", k, p, rng.choice([True, True, False, None]), False))
    rows = [(a, a % 3, i, t, p, c, s) for a, _, i, t, p, c, s in rows]
    attempts = timed(spark.createDataFrame(rows, "attempt long, learner long, item string, t long, parameter string, correct boolean, stale boolean"))
    folder, log = str(tmp_path / "in"), str(tmp_path / "log")
    attempts.limit(0).write.parquet(folder)
    whole = feed.Ending(spark.readStream.schema(attempts.schema).parquet(folder))
    made = live_learner.stream_learner(whole.rows.withWatermark("at", "200 seconds"))
    step = lambda df, number: df.write.mode("overwrite").parquet(f"{log}/trigger={number}")
    stale = attempts.withColumns({"stale": F.lit(True), "correct": ~F.col("correct")})
    # the second trigger repeats rows of the first, and has stale verdicts and earlier attempts
    for part in (attempts.where("t >= 30 and t < 70"), attempts.where("t < 50").union(stale), attempts.where("t >= 70")):
        part.write.mode("append").parquet(folder)
        feed._run(made, str(tmp_path / "job"), step, "append")
    whole.end()
    feed._run(made, str(tmp_path / "job"), step, "append")
    now = feed.latest(spark.read.parquet(log), ["learner", "item", "parameter"])
    batch = attempts.withColumn("ord", F.col("t"))
    want = {(r["learner"], r["item"], r["parameter"]): (round(r["mastery"], 9), r["attempts"]) for r in learner.mastery(batch, ["learner", "item", "parameter"]).collect()}
    assert {(r["learner"], r["item"], r["parameter"]): (round(r["mastery"], 9), r["attempts"]) for r in now.where("parameter is not null").collect()} == want
    passed = learner.passes(batch)
    spaced = {(r["learner"], r["item"]): (r["repetitions"], r["interval"], r["ease"]) for r in learner.spacing(passed).collect()}
    seen = now.groupBy("learner", "item").agg(F.max_by(F.struct("repetitions", "interval", "ease", "last_seen"), "last_seen").alias("s")).select("learner", "item", "s.*").collect()
    assert {(r["learner"], r["item"]): (r["repetitions"], r["interval"], r["ease"]) for r in seen} == spaced
    items = batch.select("learner", "item").distinct()
    due = {(r["learner"], r["item"]): r["last_seen"] for r in learner.due(passed, learner.spacing(passed), items).collect()}
    assert {(r["learner"], r["item"]): r["last_seen"] for r in seen} == due


def in_triggers(spark, frames, folder, parts):
    """The rows as a stream of files, one to a trigger."""
    return in_files(spark, timed(frames), folder, [f"t >= {low} and t < {high}" for low, high in parts])


def some_frames(spark, n=30):
    rng = random.Random(9)
    rows = [(s, t, None if rng.random() < 0.03 else rng.choice([0.0, 0.5, 2.0]), rng.random() < 0.1) for s in range(4) for t in range(n + s)]
    return rows, spark.createDataFrame(rows, "series long, t int, energy double, active boolean")


def test_streamed_log_equals_the_batch_log(spark, tmp_path):
    rows, frames = some_frames(spark)
    stream = in_triggers(spark, frames, str(tmp_path / "in"), [(9, 20), (0, 9), (20, 40)])
    log = str(tmp_path / "log")
    step = lambda df, number: df.write.mode("overwrite").parquet(f"{log}/trigger={number}")
    feed.replayed(stream, lambda s: op.stream_log(s, 12), "60 seconds", step, at_once=False)
    last = {r["series"]: r for r in sorted(spark.read.parquet(log).collect(), key=lambda r: r["n"])}
    kept, totals = op.bounded_log(frames, 12)
    want = {r["series"]: (r["dropped"], r["ever_active"]) for r in totals.collect()}
    times = {}
    for r in kept.collect():
        times.setdefault(r["series"], []).append(r["t"])
    assert {k: (r["dropped"], r["ever_active"]) for k, r in last.items()} == want
    assert {k: list(r["kept"]) for k, r in last.items()} == {k: sorted(v) for k, v in times.items()}
    assert {k: len(v) for k, v in times.items()} == dict.fromkeys(range(4), 12)
    for s in range(4):
        own = [r for r in rows if r[0] == s]
        assert want[s] == (len(own) - 12, any(r[3] for r in own)) and sorted(times[s]) == [r[1] for r in own][-12:]


def test_streamed_degraded_mode_equals_the_batch(spark, tmp_path):
    _, frames = some_frames(spark, 60)
    limits = op.Limits(1.0, 3, 4, 20)
    stream = in_triggers(spark, frames.select("series", "t", "energy"), str(tmp_path / "in"), [(20, 90), (0, 20)])
    got = told(feed.replayed(stream, lambda s: op.stream_states(s, limits), "100 seconds", at_once=False))
    assert got == told(op.states(frames, limits)) and any(e is None for e in (r["energy"] for r in frames.collect()))


def test_newest_of_each_trigger(spark, tmp_path):
    rows = [(s, t, float(t)) for s in range(3) for t in range(10)]
    frames = spark.createDataFrame(rows, "series long, t int, energy double")
    stream = in_triggers(spark, frames, str(tmp_path / "in"), [(0, 4), (4, 10)])
    got = feed.each_trigger(spark, stream, lambda df: op.newest(df, ["series"], "t", "energy"))
    assert sorted((r["trigger"], r["series"], r["energy"], r["skipped"]) for r in got.collect()) == [(k, s, e, n) for k, e, n in ((0, 3.0, 3), (1, 9.0, 5)) for s in range(3)]


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from seqloom.sources import store

    for master, fails in (("local-cluster[2,1,1024]", True), ("spark://a:7077", True), ("yarn", True), ("local[4]", False), ("local[*]", False), ("local", False)):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context)
        if fails:
            with pytest.raises(RuntimeError):
                store.shared_dir(spark)
        else:
            assert store.shared_dir(spark)


def test_sessions_that_share_a_state_stay_apart(spark):
    """Rows of different keys that agree in time and number are no repeats; a set is of neighbouring keys, and the end of a stream is in none."""
    import pandas as pd
    from pyspark.sql import functions as F

    from seqloom.streaming import feed

    rows = pd.DataFrame({"us": [5, 5, 5, 9], "t": [1, 1, 1, 2], "series": [8, 7, 7, 7]})
    out, held = feed.let_go([[], [], []], [rows], ["us", "t", "series"], 6, "series")
    assert [c.tolist() for c in out] == [[5, 5], [1, 1], [7, 8]] and held == [[9], [2], [7]]
    keys = spark.range(-20, 40).select(F.col("id").alias("k"), feed.together("k").alias("s"))
    assert keys.select("s").distinct().count() == 5 and max(r["count"] for r in keys.groupBy("s").count().collect()) == feed.TOGETHER
    assert spark.sql("select cast(null as long) as k").select(feed.together("k")).first()[0] is None
