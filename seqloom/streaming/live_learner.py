"""The learner model as a stream: each attempt is recorded once, stale verdicts are dropped, and mastery and spacing follow trigger by trigger.

Attempts (attempt, learner, item, at, parameter, correct, stale; a row for each judged parameter) come with a watermark on ``at``. Repeats within it are dropped
by their attempt and parameter, wherever they come; the rest waits for the watermark and is taken in order of time and attempt. The state of a
learner is the model of ``operators.learner`` for the items met so far (a curriculum's), the clock, and the rows that wait.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import learner as model
from seqloom.sources.package import ship
from seqloom.streaming.feed import arrived, wake

OUT = "learner long, item string, parameter string, mastery double, attempts long, repetitions int, interval int, ease double, last_seen long, clock long"


def stream_learner(attempts: DataFrame) -> DataFrame:
    """Rows of ``OUT`` for the items that a trigger changed: a row for each parameter attempted, with a null parameter where none was judged yet.

    The clock is that of the learner's last change in the trigger; an item is due when the clock has reached last_seen + interval.
    """
    ship(attempts.sparkSession)

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):  # the end of the stream
            return
        clock, items, waiting = (state.get[0], json.loads(state.get[1]), json.loads(state.get[2])) if state.exists else (0, {}, [])
        for p in arrived(parts):
            good = [None if pd.isna(c) else bool(c) for c in p["correct"]]
            waiting += [list(r) for r in zip(p["us"].tolist(), p["attempt"].tolist(), p["item"].tolist(), p["parameter"].tolist(), good, strict=True)]
        waiting.sort(key=lambda r: (r[0], r[1], r[2], str(r[3])))
        limit = state.getCurrentWatermarkMs() * 1000
        go = [r for r in waiting if r[0] <= limit]
        waiting = waiting[len(go) :]
        changed = set()
        at = 0
        while at < len(go):
            end = at
            while end < len(go) and go[end][:3] == go[at][:3]:
                end += 1
            item = go[at][2]
            known = items.setdefault(item, {"parameters": {}, "spacing": [0, 1, model.EASE], "seen": 0})
            good = True
            for _, _, _, parameter, correct in go[at:end]:
                if correct is not None:
                    good = good and correct
                    m, n = known["parameters"].get(parameter, (model.START, 0))
                    known["parameters"][parameter] = (m + model.STEP * ((1.0 if correct else 0.0) - m), n + 1)
            clock += 1
            known["spacing"], known["seen"] = list(model.advance_spacing(tuple(known["spacing"]), good)), clock
            changed.add(item)
            at = end
        state.update((clock, json.dumps(items), json.dumps(waiting)))
        wake(state, [r[0] for r in waiting])
        if not changed:
            return
        rows = [(key[0], item, parameter, m, n, *items[item]["spacing"], items[item]["seen"], clock) for item in sorted(changed) for parameter, (m, n) in (items[item]["parameters"].items() or [(None, (None, 0))])]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    fresh = attempts.where(~F.coalesce("stale", F.lit(False))).dropDuplicatesWithinWatermark(["attempt", "parameter"])
    timed = fresh.select("learner", "at", F.unix_micros("at").alias("us"), "attempt", F.col("item").cast("string").alias("item"), F.col("parameter").cast("string").alias("parameter"), "correct")
    return timed.groupBy("learner").applyInPandasWithState(run, OUT, "clock long, items string, waiting string", "append", "EventTimeTimeout")
