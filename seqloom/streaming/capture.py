"""Live capture: an idle, active, settled machine for each session, in batch as an ordered fold and as a stream with keyed state.

A frame has series, t (a long) and energy (its motion since the frame before; null when it can't be computed). In streams it also has ``at``, the event
time, and comes with a watermark: frames are held until the watermark has passed them and taken in order of at and t, whatever files and triggers they come in. The first frame of the
buffer counts as energy 0. Idle keeps the last ``preroll`` frames (all, if that is 0) and becomes active when one of the last
three energies is above the threshold; active settles when the buffer has ``longest`` frames, or else when the last ``settle``
energies are all at or below the threshold; settled stays until a reset. After a null energy the machine is degraded: a plain
window of the last ``longest`` frames that is active from ``preroll`` frames on.

While idle no energy is above the threshold, so for preroll of 3 or more the buffer is a range and the state has constant size:
state, first frame, frames in the buffer, last two energies, quiet frames in a row, whether degraded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.fold import fold
from seqloom.sources.package import ship
from seqloom.streaming.feed import arrived, let_go, together, wake

IDLE, ACTIVE, SETTLED = 0, 1, 2


@dataclass(frozen=True)
class Limits:
    threshold: float
    settle: int = 10
    preroll: int = 15
    longest: int = 150

    def __post_init__(self) -> None:
        if 0 < self.preroll < 3:
            raise ValueError("a preroll of 1 or 2 frames would need the buffer itself as state")


#: state, first frame, frames, last energy, the one before, quiet frames, degraded
Machine = tuple[int, int, int, float, float, int, bool]
FRESH: Machine = (IDLE, 0, 0, 0.0, 0.0, 0, False)
#: The machines of the sessions that share a state.
STATE = "series array<long>, state array<int>, first array<long>, n array<int>, e1 array<double>, e2 array<double>, quiet array<int>, degraded array<boolean>"
_PARTS = len(FRESH) + 1


def advance(m: Machine, t: int, energy: float | None, limits: Limits) -> Machine:
    """The machine after one more frame."""
    state, first, n, e1, e2, quiet, degraded = m
    if state == SETTLED:
        return m
    if n == 0:
        first = t
    n += 1
    if degraded:
        if n > limits.longest:
            first, n = first + n - limits.longest, limits.longest
        return (ACTIVE if n >= limits.preroll else IDLE, first, n, e1, e2, quiet, True)
    if energy is None or energy != energy:
        return (state, first, n, e1, e2, quiet, True)
    e = 0.0 if n == 1 else energy
    quiet = quiet + 1 if e <= limits.threshold else 0
    if n >= 2:
        if state == IDLE:
            if max(e, e1, e2) > limits.threshold:
                state = ACTIVE
            elif limits.preroll and n > limits.preroll:
                first, n = first + n - limits.preroll, limits.preroll
        elif n >= limits.longest or quiet >= limits.settle:
            state = SETTLED
    return (state, first, n, e, e1, quiet, False)


def replay(frames: DataFrame, settles: list[int], limits: Limits) -> DataFrame:
    """series, settle, state, start, stop, settle_index: each session replayed with each settle length, in one pass over its frames.

    A session passes through its task in batches; only a machine for each setting is held.
    """
    every = [Limits(limits.threshold, s, limits.preroll, limits.longest) for s in settles]

    def step(machines, t, energy):
        for k, each in enumerate(every):
            m, at = machines[k]
            if m[0] != SETTLED:
                m = advance(m, t, energy, each)
                machines[k] = (m, t if m[0] == SETTLED else None)
        return machines

    def finish(machines):
        return [(each.settle, m[0], m[1] if at is not None else None, at + 1 if at is not None else None, at) for each, (m, at) in zip(every, machines, strict=True)]

    kind = frames.schema["series"].dataType.simpleString()
    rows = frames.select("series", F.col("t").cast("long").alias("t"), F.col("energy").cast("double").alias("energy"))
    return fold(rows, ["series"], ["t"], ["t", "energy"], lambda: [(FRESH, None)] * len(every), step, finish, f"series {kind}, settle int, state int, start long, stop long, settle_index long")


def states(frames: DataFrame, limits: Limits) -> DataFrame:
    """series, t, state, first, n after every frame, as a batch; a session's frames pass through a task one batch at a time."""

    def step(m, t, energy):
        m = advance(m, t, energy, limits)
        return m, (t, m[0], m[1], m[2])

    kind = frames.schema["series"].dataType.simpleString()
    rows = frames.select("series", F.col("t").cast("long").alias("t"), F.col("energy").cast("double").alias("energy"))
    return fold(rows, ["series"], ["t"], ["t", "energy"], lambda: FRESH, step, None, f"series {kind}, t long, state int, first long, n int", each=True)


def _timed(frames: DataFrame, *columns: str) -> DataFrame:
    """``columns`` with at and us, the time in microseconds."""
    ship(frames.sparkSession)
    return frames.select("series", "at", F.unix_micros("at").alias("us"), F.col("t").cast("long").alias("t"), *columns)


def _machines(kept: list) -> dict[int, Machine]:
    return {s: tuple(m) for s, *m in zip(*kept, strict=True)}


def _columns(machines: dict[int, Machine]) -> list[list]:
    return [list(c) for c in zip(*((s, *m) for s, m in machines.items()), strict=True)] if machines else [[] for _ in range(_PARTS)]


def stream_states(frames: DataFrame, limits: Limits) -> DataFrame:
    """The same over a stream (series, at, t, energy), with us, the frame's time in microseconds: the keyed state is the machines of a few sessions and the frames that the watermark has not passed."""

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):  # the end of the stream
            return
        kept = [list(x) for x in state.get] if state.exists else [[] for _ in range(_PARTS + 4)]
        machines = _machines(kept[:_PARTS])
        out, held = let_go(kept[_PARTS:], arrived(parts), ["us", "t", "energy", "series"], state.getCurrentWatermarkMs() * 1000, "series")
        rows = []
        for us, t, e, s in zip(*(c.tolist() for c in out), strict=True):
            m = machines[s] = advance(machines.get(s, FRESH), t, e, limits)
            rows.append((s, us, t, m[0], m[1], m[2]))
        state.update((*_columns(machines), *held))
        wake(state, held[0])
        if rows:
            yield pd.DataFrame(rows, columns=["series", "us", "t", "state", "first", "n"])

    # a missing energy is NaN in the state
    timed = _timed(frames, F.coalesce(F.col("energy").cast("double"), F.lit(float("nan"))).alias("energy")).withColumn("_set", together("series"))
    kept = f"{STATE}, at array<long>, t array<long>, energy array<double>, of array<long>"
    return timed.groupBy("_set").applyInPandasWithState(run, "series long, us long, t long, state int, first long, n int", kept, "append", "EventTimeTimeout")


def stream_captures(frames: DataFrame, limits: Limits) -> DataFrame:
    """series, t, state, n, width, f, reset after each trigger that let frames of a session go: its buffer as it stands then.

    ``frames`` has series, at, t, energy, f (array of doubles, as long in every frame) and reset. A row with reset is no frame: it empties the buffer.
    f holds the n buffered frames one after the other, ``width`` numbers each; reset tells that a reset came since the last report. State, of a few sessions: the machine, its buffer (``longest`` frames at most) and the frames held.
    """

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):
            return
        kept = [list(x) for x in state.get] if state.exists else [[] for _ in range(_PARTS + 9)]
        machines, parts = _machines(kept[:_PARTS]), arrived(parts)
        widths, buffers, *held, sizes, f = kept[_PARTS:]
        widths, buffers = (dict(zip(kept[0], x, strict=True)) for x in (widths, buffers))
        flat = np.concatenate([np.asarray(f, float)] + [np.concatenate([np.zeros(0), *p["f"]]) for p in parts])
        sizes = [*sizes, *(len(x) for p in parts for x in p["f"])]
        ends = np.cumsum([0, *sizes])
        # a row is told by its number: its numbers in ``flat`` lie between two ends, those of a reset are none
        number = len(held[0])
        for p in parts:
            p["place"] = np.arange(number, number + len(p))
            number += len(p)
        out, held = let_go([*held, list(range(len(held[0])))], parts, ["us", "t", "energy", "reset", "series", "place"], state.getCurrentWatermarkMs() * 1000, "series")
        before, last, was_reset = dict(machines), {}, set()
        for t, e, r, s, k in zip(*(c.tolist() for c in out[1:]), strict=True):
            last[s], m = t, machines.get(s, FRESH)
            if r:
                machines[s], buffers[s] = FRESH, []
                was_reset.add(s)
                continue
            widths[s] = widths.get(s) or sizes[k]
            machines[s] = advance(m, t, e, limits)
            if m[0] != SETTLED:
                buffers[s] = [*buffers.get(s, ()), *flat[ends[k] : ends[k + 1]].tolist()][-machines[s][2] * widths[s] :]
        waiting = held.pop()
        numbers = np.concatenate([np.zeros(0)] + [flat[ends[k] : ends[k + 1]] for k in waiting]).tolist()
        state.update((*_columns(machines), [widths.get(s, 0) for s in machines], [buffers.get(s, []) for s in machines], *held, [sizes[k] for k in waiting], numbers))
        wake(state, held[0])
        told = [s for s in last if machines[s] != before.get(s, FRESH) or s in was_reset]
        if told:
            yield pd.DataFrame({"series": told, "t": [last[s] for s in told], "state": [machines[s][0] for s in told], "n": [machines[s][2] for s in told], "width": [widths.get(s, 0) for s in told], "f": [buffers[s] for s in told], "reset": [s in was_reset for s in told]})

    reset = F.coalesce("reset", F.lit(False)) if "reset" in frames.columns else F.lit(False)
    # a tie of a reset and a frame goes by t
    values = F.when(reset, F.array().cast("array<double>")).otherwise(F.col("f").cast("array<double>"))
    timed = _timed(frames, F.coalesce(F.col("energy").cast("double"), F.lit(float("nan"))).alias("energy"), values.alias("f"), reset.alias("reset")).withColumn("_set", together("series"))
    kept = f"{STATE}, width array<int>, buffer array<array<double>>, at array<long>, t array<long>, energy array<double>, reset array<boolean>, of array<long>, sizes array<int>, f array<double>"
    return timed.groupBy("_set").applyInPandasWithState(run, "series long, t long, state int, n int, width int, f array<double>, reset boolean", kept, "append", "EventTimeTimeout")


def graded(captures: DataFrame, grade: Callable[[DataFrame], DataFrame], least: int = 20) -> DataFrame:
    """A trigger's changes of the table of verdicts: series, t, n, stale and what ``grade`` adds, for captures (a trigger's reports) to be graded or made stale.

    A capture that is not idle and has ``least`` frames is graded as it stands, and replaces the session's verdict; one that was reset and is not yet
    long enough leaves the verdict there, but stale. ``grade`` takes series, n, width, f and returns series and its columns.
    """
    open_ = (F.col("state") != IDLE) & (F.col("n") >= least)
    found = grade(captures.where(open_).select("series", "n", "width", "f"))
    return captures.where(open_ | F.col("reset")).select("series", "t", "n", (~open_).alias("stale")).join(found, "series", "left")


def verdicts(log: DataFrame) -> DataFrame:
    """The table of verdicts that a table of triggers' changes amounts to: a row for each session that was graded, stale if it has been reset since."""
    judged = F.when(~F.col("stale"), F.col("trigger"))
    rest = [c for c in log.columns if c not in ("series", "stale", "trigger")]
    g = log.groupBy("series").agg(F.max_by(F.struct(*rest), judged).alias("_r"), F.max(judged).alias("_judged"), F.max("trigger").alias("_last"))
    return g.where("_judged is not null").select("series", "_r.*", (F.col("_last") > F.col("_judged")).alias("stale"))


def captured_spans(state_rows: DataFrame) -> DataFrame:
    """series, start, stop of sessions that settled: up to the first settled frame, as long as its buffer."""
    first = state_rows.where(F.col("state") == SETTLED).groupBy("series").agg(F.min(F.struct("t", "n")).alias("s"))
    return first.select("series", F.greatest(F.lit(0), F.col("s.t") + 1 - F.col("s.n")).alias("start"), (F.col("s.t") + 1).alias("stop"))


def bounded_log(frames: DataFrame, cap: int = 1800) -> tuple[DataFrame, DataFrame]:
    """The newest ``cap`` frames of each session, and series, kept, dropped, ever_active."""
    from pyspark.sql import Window as W

    kept = frames.withColumn("_r", F.row_number().over(W.partitionBy("series").orderBy(F.desc("t")))).where(F.col("_r") <= cap).drop("_r")
    totals = frames.groupBy("series").agg(F.count("*").alias("n"), F.bool_or("active").alias("ever_active"))
    return kept, totals.select("series", F.least("n", F.lit(cap)).alias("kept"), F.greatest(F.lit(0), F.col("n") - cap).alias("dropped"), "ever_active")


def settle_frames(fps, seconds: float = 1.2, least: int = 15, default: int = 30):
    """Frames of quiet that settle a session at a given rate."""
    return F.coalesce(F.greatest(F.lit(least), F.rint(fps * seconds).cast("int")), F.lit(default))


def newest(frames: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, value, skipped: only the newest frame of each key and trigger counts; older ones are skipped."""
    return frames.groupBy(*keys).agg(F.max_by(value, order).alias(value), (F.count("*") - 1).alias("skipped"))


def gradable(state_rows: DataFrame, least: int = 20, reset: str | None = None) -> DataFrame:
    """Frames at which an open capture may be graded (not idle, enough frames), with stale where a later reset has made it void."""
    df = state_rows.where((F.col("state") != IDLE) & (F.col("n") >= least))
    return df.withColumn("stale", F.col(reset).isNotNull() & (F.col("t") < F.col(reset)) if reset else F.lit(False))


def stream_log(frames: DataFrame, cap: int = 1800) -> DataFrame:
    """The bounded recorder over a stream (series, at, t, active): after each trigger series, n, kept (the newest ``cap`` t), dropped, ever_active.

    The state of a session holds at most ``cap`` frames and those that the watermark has not passed.
    """

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):
            return
        kept, n, ever, *held = state.get if state.exists else ([], 0, False, [], [], [])
        out, held = let_go([list(x) for x in held], arrived(parts), ["us", "t", "active"], state.getCurrentWatermarkMs() * 1000)
        kept = [*kept, *out[1].tolist()][-cap:]
        n, ever = n + len(out[1]), bool(ever or out[2].any())
        state.update((kept, n, ever, *held))
        wake(state, held[0])
        if len(out[1]):
            yield pd.DataFrame({"series": [key[0]], "n": [n], "kept": [kept], "dropped": [n - len(kept)], "ever_active": [ever]})

    out = "series long, n long, kept array<long>, dropped long, ever_active boolean"
    timed = _timed(frames, F.coalesce("active", F.lit(False)).alias("active"))
    return timed.groupBy("series").applyInPandasWithState(run, out, "kept array<long>, n long, ever boolean, at array<long>, t array<long>, active array<boolean>", "append", "EventTimeTimeout")
