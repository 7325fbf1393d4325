"""Tables as streams, the end of a stream, and the tables that streams write.

Stateful operators of this package hold rows back until the watermark has passed them, and then take them in order of time; so neither the order of
files nor that of triggers matters, and what comes later than the watermark allows is late and left out, as Spark has it. The watermark of a table that
has been read to its end stays at its newest rows. ``replayed`` therefore ends the stream with a row of nothing but a time in the far future: all rows before
it are let go. Times are after 1970 and before ``END``.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.sources.store import discarded, fresh_path

END = datetime.datetime(2261, 1, 1)
#: Keys that share a state: a call of Python for each key costs more than the rows of a short history.
TOGETHER = 16


def of_table(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The rows of a Parquet table, a file or a folder of files, as a stream; ``files``: at most so many files in a trigger."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a stream's own path must be a folder; what a pattern finds may be a file


def _run(stream: DataFrame, path: str, step: Callable[[DataFrame, int], None] | None, mode: str) -> None:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
    job = writer.foreachBatch(step).start() if step else writer.format("parquet").start(path)
    job.awaitTermination()


def _written(spark: SparkSession, path: str, schema) -> DataFrame:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    discarded(spark, f"{path}-checkpoint")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(discarded(spark, path))


def drain(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into a folder that all executors share, and read what it wrote."""
    path = fresh_path(spark, "stream")
    _run(stream, path, None, mode)
    return _written(spark, path, stream.schema)


def each_trigger(spark: SparkSession, stream: DataFrame, step: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What ``step`` makes of each trigger's rows, with the trigger's number; a trigger that is run again replaces its part. No trigger: no rows."""
    path = fresh_path(spark, "triggers")
    seen = []

    def write(rows: DataFrame, number: int) -> None:
        made = step(rows)
        seen[:] = [made.schema]
        made.write.mode("overwrite").parquet(f"{path}/trigger={number}")

    _run(stream, path, write, mode)
    schema = seen[0] if seen else step(spark.createDataFrame([], stream.schema)).schema
    return _written(spark, path, type(schema)(schema.fields).add("trigger", "integer"))


def arriving(parts: list[DataFrame], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``step`` makes of each part, with the trigger's number: the parts arrive in a folder one after the other, and one stream takes up each, restarted where it was."""
    spark = parts[0].sparkSession
    source, path = fresh_path(spark, "arrivals"), fresh_path(spark, "triggers")
    discarded(spark, source)
    parts[0].limit(0).write.parquet(source)
    made = step(parts[0].limit(0))

    def write(rows: DataFrame, number: int) -> None:
        step(rows).write.mode("overwrite").parquet(f"{path}/trigger={number}")

    stream = spark.readStream.schema(parts[0].schema).parquet(source)
    for part in parts:
        part.write.mode("append").parquet(source)
        _run(stream, path, write, "append")
    schema = made.schema
    return _written(spark, path, type(schema)(schema.fields).add("trigger", "integer"))


class Ending:
    """A stream that can be ended: ``rows`` is the stream and then, after ``end()``, one more row with null in all columns but ``at``."""

    def __init__(self, stream: DataFrame, at: str = "at"):
        self.spark, self.schema, self.at = stream.sparkSession, stream.schema, at
        self.path = fresh_path(self.spark, "end")
        discarded(self.spark, self.path)
        self.spark.createDataFrame([], self.schema).write.parquet(self.path)
        self.rows = stream.union(self.spark.readStream.schema(self.schema).parquet(self.path))

    def end(self) -> None:
        columns = [F.lit(END if f.name == self.at else None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        self.spark.range(1).select(*columns).write.mode("append").parquet(self.path)


def replayed(stream: DataFrame, build: Callable[[DataFrame], DataFrame], delay: str = "0 seconds", step: Callable[[DataFrame, int], None] | None = None, at_once: bool = True) -> DataFrame | None:
    """What ``build`` makes of the watermarked stream (event time ``at``), run over all that is there and then ended.

    ``at_once``: the source gives all in one trigger, so the end may come with it. With ``step``, each trigger's rows go to it and nothing is returned.
    """
    spark = stream.sparkSession
    whole = Ending(stream)
    made = build(whole.rows.withWatermark("at", delay))
    path = fresh_path(spark, "stream")
    if not at_once:
        _run(made, path, step, "append")
    whole.end()
    _run(made, path, step, "append")
    if not step:
        return _written(spark, path, made.schema)
    discarded(spark, f"{path}-checkpoint")
    return None


def latest(log: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key of a table of triggers, as upserts leave it."""
    rest = [c for c in log.columns if c not in (*keys, "trigger")]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "trigger").alias("_r")).select(*keys, "_r.*")


def together(key: str):
    """The set of ``TOGETHER`` neighbouring keys (numbers) that share a state; null for the end of a stream."""
    return F.floor(F.col(key) / TOGETHER)


def let_go(held: list[list], parts: list[pd.DataFrame], columns: list[str], watermark: int, key: str | None = None) -> tuple[list[np.ndarray], list[list]]:
    """Columns of the rows that the watermark (in microseconds) has passed, in order, and of those that stay held.

    The first two columns are the time in microseconds and what tells rows of one time apart; of rows that agree in both the first counts. Where several keys
    stand together, ``key`` names their column: rows are ordered, and told apart, by it first.
    """
    if parts:
        new = [np.concatenate([p[c].to_numpy() for p in parts]) for c in columns]
        both = [np.concatenate([np.asarray(h, n.dtype), n]) for h, n in zip(held, new, strict=True)]
    else:
        both = [np.asarray(h, np.int64 if not len(h) else None) for h in held]
    marks = [both[0].astype(np.int64), both[1].astype(np.int64)] + ([both[columns.index(key)].astype(np.int64)] if key else [])
    order = np.lexsort((np.arange(len(marks[0])), marks[1], marks[0], *marks[2:]))
    marks = [m[order] for m in marks]
    order = order[np.append(True, np.logical_or.reduce([m[1:] != m[:-1] for m in marks]))[: len(order)]]
    both = [c[order] for c in both]
    gone = both[0].astype(np.int64) <= watermark
    return [c[gone] for c in both], [c[~gone].tolist() for c in both]


def arrived(parts) -> list[pd.DataFrame]:
    """The rows of a call; Spark calls a key that is only woken up with a row of nulls."""
    found = [p[p["us"].notna()] for p in parts]
    return [p.reset_index(drop=True) for p in found if len(p)]


def wake(state, held_at: list[int]) -> None:
    """Have the key called again as soon as the watermark reaches the first row that it holds (Spark calls when it is above what is set)."""
    if held_at:
        state.setTimeoutTimestamp(max(-(-min(held_at) // 1000) - 1, state.getCurrentWatermarkMs()))


def in_order(stream: DataFrame, key: str, tie: str) -> DataFrame:
    """The rows of a watermarked stream (event time ``at``, numbers ``key`` and ``tie``), held back until the watermark has passed them.

    Rows with a null key end the stream and are left out; rows of one key that agree in time and ``tie`` are repeats. What a trigger gives is later than
    all that triggers before it gave, but for equal times of the watermark itself.
    """
    names = [c for c in stream.columns if c not in ("at", tie)]
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    columns = ["us", tie, *names]

    def run(key_of, parts, state):
        if pd.isna(key_of[0]):
            return
        held = [list(x) for x in state.get] if state.exists else [[] for _ in columns]
        out, held = let_go(held, arrived(parts), columns, state.getCurrentWatermarkMs() * 1000, key)
        if held[0]:
            state.update(tuple(held))
            wake(state, held[0])
        elif state.exists:
            state.remove()
        if len(out[0]):
            yield pd.DataFrame(dict(zip(columns, out, strict=True)))

    numbered = stream.withColumn("us", F.unix_micros("at")).withColumn("_set", together(key))
    kinds["us"] = "bigint"
    out = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    kept = ", ".join(f"`{c}` array<{kinds[c]}>" for c in columns)
    from seqloom.sources.package import ship

    ship(stream.sparkSession)
    return numbered.groupBy("_set").applyInPandasWithState(run, out, kept, "append", "EventTimeTimeout").withColumn("at", F.timestamp_micros("us")).drop("us")
