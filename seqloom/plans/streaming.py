"""Streaming operators over the events: users are sessions; a value above 120 is motion."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import signal
from seqloom.plans.bind import FRAMES, frames, table
from seqloom.plans.learner import _A, _M, _PASS, _SM2
from seqloom.plans.registry import query
from seqloom.plans.signal import rounded
from seqloom.sources.store import stored
from seqloom.streaming import admission, feed, live_learner
from seqloom.streaming import capture as op

LIMITS = op.Limits(threshold=120.0, settle=6, preroll=5, longest=30)


def _fold(settle: str) -> str:
    """The machine in SQL: elements and state share one struct, as DuckDB's fold wants."""
    e = "(CASE WHEN s.n = 0 THEN 0.0::DOUBLE ELSE x.e1 END)"
    quiet = f"(CASE WHEN {e} <= 120 THEN s.quiet + 1 ELSE 0 END)"
    make = lambda st, first, n, at: f"{{'state': {st}, 'first': {first}, 'n': {n}, 'e1': {e}, 'e2': s.e1, 'quiet': {quiet}, 'at': {at}}}"
    first = "(CASE WHEN s.n = 0 THEN x.first ELSE s.first END)"
    return f"""list_reduce(array_agg({{'state': 0, 'first': t, 'n': 0, 'e1': energy, 'e2': 0.0::DOUBLE, 'quiet': 0, 'at': CAST(NULL AS INT)}} ORDER BY t), lambda s, x: CASE WHEN s.state = 2 THEN s
 WHEN s.n = 0 THEN {make('s.state', first, 's.n + 1', 's.at')} WHEN s.state = 0 AND greatest({e}, s.e1, s.e2) > 120 THEN {make('1', first, 's.n + 1', 's.at')}
 WHEN s.state = 0 THEN {make('0', first + ' + greatest(0, s.n + 1 - 5)', 'least(s.n + 1, 5)', 's.at')} WHEN s.n + 1 >= 30 OR {quiet} >= {settle} THEN {make('2', first, 's.n + 1', 'x.first')} ELSE {make('1', first, 's.n + 1', 's.at')} END,
 {{'state': 0, 'first': 0, 'n': 0, 'e1': 0.0::DOUBLE, 'e2': 0.0::DOUBLE, 'quiet': 0, 'at': CAST(NULL AS INT)}})"""


_REPLAY = f"""{FRAMES}, gr AS (SELECT unnest([3, 6, 10]) AS settle), f AS (SELECT series, settle, {_fold('settle')} AS s FROM frames, gr GROUP BY series, settle),
rp AS (SELECT series, settle, s.state AS state, CASE WHEN s.state = 2 THEN s.first END AS start, CASE WHEN s.state = 2 THEN s.at + 1 END AS stop, s.at AS settle_index FROM f)"""


def _stream(spark, sf_dir):
    """The events as a stream of frames; t is the event's number."""
    e = feed.of_table(spark, f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("series"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("t"), F.col("value").alias("energy"), "event_type")


@query("s1_capture_stream", f"WITH {FRAMES}, f AS (SELECT series, {_fold('6')} AS s FROM (SELECT series, ts, t AS k, event_id AS t, energy FROM frames) GROUP BY series) SELECT series, s.state AS state, s.n AS n, s.at AS settle_index FROM f".replace("ORDER BY t)", "ORDER BY k)").replace("CAST(NULL AS INT)", "CAST(NULL AS BIGINT)"))
def capture_stream(spark, sf_dir):
    rows = feed.replayed(_stream(spark, sf_dir), lambda s: op.stream_states(s, LIMITS))
    when = F.struct("us", "t")
    g = rows.groupBy("series").agg(F.max_by(F.struct("state", "n"), when).alias("s"), F.min_by("t", F.when(F.col("state") == op.SETTLED, when)).alias("settle_index"))
    return g.select("series", "s.state", "s.n", "settle_index")


def _degraded():
    """The machine with its degraded mode in SQL, with what it is after each frame."""
    e, deg = "(CASE WHEN s.n = 0 THEN 0.0::DOUBLE ELSE x.e1 END)", "(s.degraded OR (s.state <> 2 AND x.e1 IS NULL))"
    quiet = f"(CASE WHEN {e} <= 120 THEN s.quiet + 1 ELSE 0 END)"
    moving = f"greatest({e}, s.e1, s.e2) > 120"
    state = f"(CASE WHEN s.state = 2 THEN 2 WHEN s.degraded THEN CASE WHEN least(s.n + 1, 30) >= 5 THEN 1 ELSE 0 END WHEN x.e1 IS NULL OR s.n = 0 THEN s.state WHEN s.state = 0 THEN CASE WHEN {moving} THEN 1 ELSE 0 END WHEN s.n + 1 >= 30 OR {quiet} >= 6 THEN 2 ELSE s.state END)"
    n = f"(CASE WHEN s.state = 2 THEN s.n WHEN s.degraded THEN least(s.n + 1, 30) WHEN x.e1 IS NULL OR s.n = 0 THEN s.n + 1 WHEN s.state = 0 AND NOT {moving} THEN least(s.n + 1, 5) ELSE s.n + 1 END)"
    kept = lambda new, old: f"CASE WHEN s.state = 2 OR {deg} THEN {old} ELSE {new} END"
    step = f"{{'state': {state}, 'n': {n}, 'e1': {kept(e, 's.e1')}, 'e2': {kept('s.e1', 's.e2')}, 'quiet': {kept(quiet, 's.quiet')}, 'degraded': {deg}, 't': x.t, 'out': list_append(s.out, {{'t': x.t, 'state': {state}, 'n': {n}}})}}"
    none = "CAST([] AS STRUCT(t BIGINT, state INT, n INT)[])"
    make = lambda energy, t: f"{{'state': 0, 'n': 0, 'e1': {energy}, 'e2': 0.0::DOUBLE, 'quiet': 0, 'degraded': false, 't': {t}, 'out': {none}}}"
    return f"list_reduce(array_agg({make('energy', 't')} ORDER BY ts, t), lambda s, x: {step}, {make('0.0::DOUBLE', '0::BIGINT')}).out"


@query("s2_degraded", f"SELECT series, o.t AS t, o.state AS state, o.n AS n FROM (SELECT series, unnest({_degraded()}) AS o FROM (SELECT user_id AS series, ts, event_id AS t, CASE WHEN event_type <> 'error' THEN value END AS energy FROM events) GROUP BY series)")
def degraded(spark, sf_dir):
    """The capture stream where errors have no energy: from a session's first error on, its machine is a plain window."""
    frames = _stream(spark, sf_dir).withColumn("energy", F.when(F.col("event_type") != "error", F.col("energy")))
    return feed.replayed(frames, lambda s: op.stream_states(s, LIMITS)).select("series", "t", "state", "n")


@query("s3_bounded_log", f"""WITH {FRAMES}, k AS (SELECT series, t, energy, row_number() OVER (PARTITION BY series ORDER BY t DESC) AS r FROM frames),
s AS (SELECT series, greatest(0, count(*) - 60) AS dropped, bool_or(energy > 120) AS ever_active FROM frames GROUP BY series) SELECT series, t, energy, dropped, ever_active FROM k JOIN s USING (series) WHERE r <= 60""")
def bounded_log(spark, sf_dir):
    kept, totals = op.bounded_log(frames(spark, sf_dir).withColumn("active", F.col("energy") > 120), 60)
    return kept.join(totals, "series").select("series", "t", "energy", "dropped", "ever_active")


@query("s4_captured_span", f"WITH {_REPLAY} SELECT series, start, stop FROM rp WHERE settle = 6 AND state = 2")
def captured_span(spark, sf_dir):
    done = op.replay(frames(spark, sf_dir), [LIMITS.settle], LIMITS)
    return done.where(F.col("state") == op.SETTLED).select("series", "start", "stop")


def _replayed(spark, sf_dir):
    return op.replay(frames(spark, sf_dir), [3, 6, 10], LIMITS)


@query("s5_replay", f"WITH {_REPLAY} SELECT series, settle, state, start, stop, settle_index FROM rp")
def replay(spark, sf_dir):
    return _replayed(spark, sf_dir)


@query("s6_replay_study", f"""WITH {_REPLAY}, n AS (SELECT series, count(*) AS n, max(t) FILTER (WHERE energy > 120) AS last FROM frames GROUP BY series)
SELECT settle, count(*) AS n, count(*) FILTER (WHERE state = 2) AS settled, count(*) FILTER (WHERE state = 2 AND settle_index < last) AS premature, count(*) FILTER (WHERE state <> 2) AS never, count(*) FILTER (WHERE state = 2 AND stop - start >= 30) AS hit_cap,
 round(quantile_cont(settle_index, 0.5), 6) AS median_index FROM rp JOIN n USING (series) GROUP BY settle""")
def replay_study(spark, sf_dir):
    last = frames(spark, sf_dir).groupBy("series").agg(F.max(F.when(F.col("energy") > 120, F.col("t"))).alias("last"))
    df = _replayed(spark, sf_dir).join(last, "series")
    done = F.col("state") == op.SETTLED
    g = df.groupBy("settle").agg(F.count("*").alias("n"), F.count_if(done).alias("settled"), F.count_if(done & (F.col("settle_index") < F.col("last"))).alias("premature"), F.count_if(~done).alias("never"), F.count_if(done & (F.col("stop") - F.col("start") >= LIMITS.longest)).alias("hit_cap"), F.percentile("settle_index", F.lit(0.5)).alias("median_index"))
    return rounded(g)


@query("s7_settle_frames", f"""WITH {FRAMES}, s AS (SELECT series, count(*) AS n, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM frames GROUP BY series)
SELECT series, CAST(coalesce(greatest(15, round_even((n - 1) / ((b - a) / 1e6) * 86400 * 12, 0)), 30) AS INT) AS settle FROM s""")
def settle_frames(spark, sf_dir):
    rate = signal.stream_rate(frames(spark, sf_dir), F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return rate.select("series", op.settle_frames(F.col("fps") * 86400, seconds=12.0).alias("settle"))


def _kinds(spark, sf_dir):
    """event_type and what its clip is known by: mean and largest value of its events."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.max("value").alias("most"))


def _nearest_kind(kinds):
    """Grades captures by the event type whose mean and largest value are nearest to the buffer's."""

    def grade(rows):
        mean, most = F.aggregate("f", F.lit(0.0), lambda a, x: a + x) / F.size("f"), F.array_max("f")
        # a row for each event type
        met = rows.select("series", mean.alias("_mean"), most.alias("_most")).join(kinds, how="cross")
        distance = F.sqrt((F.col("mean") - F.col("_mean")) ** 2 + (F.col("most") - F.col("_most")) ** 2)
        best = met.groupBy("series").agg(F.min(F.struct(F.round(distance, 6).alias("distance"), "event_type")).alias("b"))
        return best.select("series", F.col("b.event_type").alias("label"), F.col("b.distance").alias("distance"))

    return grade


@query("s8_gradable", f"""WITH {FRAMES}, f AS (SELECT series, {_fold('6')} AS s FROM frames GROUP BY series), b AS (SELECT f.series, s.n AS n, arg_max(event_id, t) AS last, avg(energy) AS m, max(energy) AS x
  FROM f JOIN frames ON f.series = frames.series AND t >= s.first AND t < s.first + s.n WHERE s.state <> 0 AND s.n >= 20 GROUP BY f.series, s.n),
k AS (SELECT event_type AS label, avg(value) AS mean, max(value) AS most FROM events GROUP BY 1),
d AS (SELECT series, n, label, round(sqrt((mean - m) * (mean - m) + (most - x) * (most - x)), 6) AS distance FROM b, k)
SELECT series, n, label, distance, false AS stale FROM d QUALIFY row_number() OVER (PARTITION BY series ORDER BY distance, label) = 1""")
def gradable(spark, sf_dir):
    """Continuous grading: each trigger grades the open captures as they stand, and a session's verdict is replaced as its capture grows."""
    kinds = F.broadcast(_kinds(spark, sf_dir))  # a row for each event type
    log = feed.fresh_path(spark, "verdicts")
    grade = _nearest_kind(kinds)
    # a trigger's captures are read twice: stored, the stream's step runs once
    step = lambda rows, number: op.graded(stored(rows, "captures"), grade).write.mode("overwrite").parquet(f"{log}/trigger={number}")
    feed.replayed(_stream(spark, sf_dir).withColumn("f", F.array("energy")), lambda s: op.stream_captures(s, LIMITS), step=step)
    return op.verdicts(spark.read.parquet(feed.discarded(spark, log))).select("series", "n", "label", "distance", "stale")


@query("s9_newest", """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CAST(hour(ts) // 8 AS INT) AS trigger, arg_max(event_id, (ts, event_id)) AS event_id, count(*) - 1 AS skipped FROM events GROUP BY 1, 2, 3""")
def newest(spark, sf_dir):
    """A trigger of the stream keeps the newest event of each user and day; the events of each third of a day arrive together, so there are three triggers."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    parts = [e.where(F.floor(F.hour("ts") / 8) == k) for k in range(3)]
    step = lambda rows: op.newest(rows, ["user_id", "day"], F.struct("ts", "event_id"), "event_id")
    return feed.arriving(parts, step)


@query("s10_record_once", f"WITH {_A}, {_M}, {_PASS}, {_SM2} SELECT learner, item, parameter, mastery, attempts, s.reps AS repetitions, s.interval AS interval, s.ease AS ease FROM m JOIN sm USING (learner, item)")
def record_once(spark, sf_dir):
    """Every event arrives twice, and a stale verdict of it, too; the learner's state follows as if it had come once."""
    e = feed.of_table(spark, f"{sf_dir}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    copies = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    right = F.when(F.col("event_type") != "error", F.col("value") > 30)
    stale = F.col("copy") == 1
    a = copies.select(F.col("event_id").alias("attempt"), F.col("user_id").alias("learner"), F.col("event_type").alias("item"), "at", F.concat(F.lit("p"), F.col("event_id") % 3).alias("parameter"), F.when(stale, ~right).otherwise(right).alias("correct"), stale.alias("stale"))
    log = feed.fresh_path(spark, "learners")
    step = lambda rows, number: rows.write.mode("overwrite").parquet(f"{log}/trigger={number}")
    feed.replayed(a, live_learner.stream_learner, step=step)
    now = feed.latest(spark.read.parquet(feed.discarded(spark, log)), ["learner", "item", "parameter"]).where("parameter is not null")
    # an item's spacing moves on with any of its parameters
    item = now.groupBy("learner", "item").agg(F.max_by(F.struct("repetitions", "interval", "ease"), "last_seen").alias("s"))
    return now.select("learner", "item", "parameter", "mastery", "attempts").join(item.select("learner", "item", "s.*"), ["learner", "item"])


def _calls(e):
    at = F.col("ts").cast("timestamp")
    return e.select(F.col("event_id").alias("call"), F.col("user_id").alias("client"), (F.unix_micros(at) / 1e6).alias("time"), F.to_date("ts").cast("string").alias("day"), at.alias("at"))


@query("s11_admission")
def admit(spark, sf_dir):
    """The calls as a stream: held back, let go in order of time, judged trigger by trigger."""
    gate = admission.Gate(spark, feed.discarded(spark, feed.fresh_path(spark, "gate")), daily=250, most=2, window=43200.0)
    feed.replayed(_calls(feed.of_table(spark, f"{sf_dir}/events.parquet")), admission.stream, step=gate.step)
    return gate.told()


@query("s11_admission_batch")
def admit_batch(spark, sf_dir):
    return admission.admit(_calls(table(spark, sf_dir, "events")), daily=250, most=2, window=43200.0)


@query("s12_event_log", """SELECT '{"kind":"' || event_type || '","id":' || event_id || ',"time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","ok":' || (event_type <> 'error') || '}' AS line FROM events""")
def event_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), (F.col("event_type") != "error").alias("ok"))).alias("line"))
