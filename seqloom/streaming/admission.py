"""Admission control: a cap for each day over all clients, and a cap for each client in a sliding window; refused calls don't count.

Each client's calls are folded in order: a call passes the client's cap if fewer than ``most`` admitted calls of the client lie in the window before. A day
closes with its ``daily``-th call that passes; calls after that are refused, and only a client's window that reaches over the end of a closed day has to know.
So all days are judged side by side, with the closes known so far, until no close moves: the first day is right in the first round, each later one at the latest a round
after the day before it, and two rounds do unless closed days follow one another in such windows. No table of a day or a client is gathered: clients pass through their
tasks in batches with at most ``most`` times as state, and a day's close is a rank of which each task hands on ``daily`` rows.

As a stream, calls are held back until the watermark has passed them, each trigger judges what was let go, and what the next one must know is a table of the
trigger: the admitted calls of the last window, and how many each day has. A trigger that is run again reads the table of the one before it and writes its own anew.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators.fold import fold
from seqloom.sources.store import discarded, fresh_path
from seqloom.streaming import feed

CALL = ["call", "client", "time", "day"]


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _passing(calls: DataFrame, known: DataFrame, closes: DataFrame, most: int, window: float) -> DataFrame:
    """The calls with ok: whether they pass their client's cap, if days close as ``closes`` (day, time, call) says; ``known`` calls were admitted before."""
    late = F.col("_time").isNotNull() & (F.struct(F.col("time"), F.col("call")) > F.struct(F.col("_time"), F.col("_call")))
    timed = calls.join(closes.select("day", F.col("time").alias("_time"), F.col("call").alias("_call")), "day", "left")
    rows = timed.select(*CALL, late.alias("late"), F.lit(False).alias("known")).union(known.select(*CALL, F.lit(False), F.lit(True)))

    def step(q, call, time, day, late, was_admitted):
        while q and time - q[0][0] > window:
            q.popleft()
        if was_admitted:
            q.append((time, day, False))
            return q, (call, time, day, None)
        # what a closed day refused counts in no later day; in its own day all later calls are refused, too
        if sum(1 for _, d, gone in q if not gone or d == day) >= most:
            return q, (call, time, day, False)
        q.append((time, day, late))
        return q, (call, time, day, True)

    kinds = {f.name: f.dataType.simpleString() for f in calls.schema.fields}
    out = f"client {kinds['client']}, call {kinds['call']}, time double, day {kinds['day']}, ok boolean"
    return fold(rows, ["client"], ["time", "call"], ["call", "time", "day", "late", "known"], deque, step, None, out, each=True).where("ok is not null")


def judge(calls: DataFrame, known: DataFrame, counts: DataFrame, daily: int, most: int, window: float) -> DataFrame:
    """call, client, time, day, admitted for ``calls``; ``known`` calls were admitted before, ``counts`` (day, n) says how many of each day."""
    spark = calls.sparkSession
    path = fresh_path(spark, "admission")
    discarded(spark, path)
    closes = spark.createDataFrame([], f"day {calls.schema['day'].dataType.simpleString()}, time double, call {calls.schema['call'].dataType.simpleString()}")
    number = 0
    while True:
        judged = _stored(_passing(calls, known, closes, most, window), f"{path}/judged-{number}")
        first = F.row_number().over(W.partitionBy("day").orderBy("time", "call"))
        ranked = judged.where("ok").select("day", "time", "call", first.alias("rank")).where(F.col("rank") <= daily)
        left = F.lit(daily) - F.coalesce("n", F.lit(0))
        found = ranked.join(counts, "day", "left").where((F.col("rank") == left) | ((left <= 0) & (F.col("rank") == 1)))
        # a day that was full before closes ahead of its first call
        now = _stored(found.select("day", F.when(left > 0, F.col("time")).otherwise(F.lit(float("-inf"))).alias("time"), "call"), f"{path}/closes-{number}")
        moved = now.exceptAll(closes).limit(1).count() + closes.exceptAll(now).limit(1).count()
        closes, number = now, number + 1
        if not moved:
            break
    inside = F.col("_time").isNull() | (F.struct(F.col("time"), F.col("call")) <= F.struct(F.col("_time"), F.col("_call")))
    judged = judged.join(closes.select("day", F.col("time").alias("_time"), F.col("call").alias("_call")), "day", "left")
    return judged.select(*CALL, (F.col("ok") & inside).alias("admitted"))


def admit(calls: DataFrame, daily: int = 1000, most: int = 30, window: float = 600.0) -> DataFrame:
    """call, client, admitted for ``calls`` (call, client, time in seconds, day), in order of time and call; days follow one another in time."""
    calls = calls.select(*CALL)
    counts = calls.sparkSession.createDataFrame([], f"day {calls.schema['day'].dataType.simpleString()}, n long")
    return judge(calls, calls.limit(0), counts, daily, most, window).select("call", "client", "admitted")


class Gate:
    """Admission of a stream, trigger by trigger, with what it has to know in tables below ``path``; made again on the same path, it goes on where it was."""

    def __init__(self, spark: SparkSession, path: str, daily: int = 1000, most: int = 30, window: float = 600.0):
        self.spark, self.path, self.daily, self.most, self.window = spark, path, daily, most, window

    def _before(self, number: int) -> int | None:
        """The last trigger before ``number`` whose tables are whole."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/counts")
        files = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(place):
            return None
        done = [int(s.getPath().getName().split("=")[1]) for s in files.listStatus(place) if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((n for n in done if n < number), default=None)

    def step(self, rows: DataFrame, number: int) -> None:
        """Judge the calls (call, client, time, day) of a trigger; they are later than those of the triggers before."""
        calls, last = rows.select(*CALL), self._before(number)
        read = lambda name: self.spark.read.parquet(f"{self.path}/{name}/trigger={last}")
        known = calls.limit(0) if last is None else read("known").select(*CALL)
        counts = self.spark.createDataFrame([], f"day {calls.schema['day'].dataType.simpleString()}, n long") if last is None else read("counts").select("day", "n")
        calls = _stored(calls, f"{self.path}/calls/trigger={number}")  # they are read several times
        if not calls.limit(1).count():
            return
        told = judge(calls, known, counts, self.daily, self.most, self.window)
        told = _stored(told, f"{self.path}/told/trigger={number}")
        admitted = told.where("admitted").select(*CALL).union(known)
        newest = told.agg(F.max("time").alias("_newest"))
        kept = admitted.join(F.broadcast(newest), F.col("_newest").isNull() | (F.col("_newest") - F.col("time") <= self.window)).drop("_newest")  # a row for each trigger
        kept.write.mode("overwrite").parquet(f"{self.path}/known/trigger={number}")
        added = told.where("admitted").groupBy("day").agg(F.count("*").alias("n")).union(counts)
        added.groupBy("day").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{self.path}/counts/trigger={number}")

    def told(self) -> DataFrame:
        """call, client, admitted of all triggers so far."""
        return self.spark.read.option("basePath", f"{self.path}/told").parquet(f"{self.path}/told/trigger=*").select("call", "client", "admitted")


def stream(calls: DataFrame) -> DataFrame:
    """The calls of a watermarked stream (call, client, time, day and the event time ``at``) in order of time, for ``Gate.step``; clients are numbers."""
    return feed.in_order(calls, "client", "call")
