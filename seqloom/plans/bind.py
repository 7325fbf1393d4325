"""The given tables read as the engine's inputs, in Spark and in SQL.

* frames: each user's events in time order; value is the motion energy, an error is a frame without presence.
* points: each embedding is a pose of 32 points (x, y); a point whose |x| is below 0.02 was not detected; ten poses are a clip.
* attempts: each event is an attempt of its user at the item ``event_type``; correct is value > 30, null for errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, t, energy, present, label, seconds."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series"), (F.row_number().over(order) - 1).alias("t"), F.col("value").alias("energy"), (F.col("event_type") != "error").alias("present"), F.col("event_type").alias("label"), "ts", "event_id"
    )


FRAMES = """frames AS (SELECT user_id AS series, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS t,
  value AS energy, event_type <> 'error' AS present, event_type AS label, ts, event_id FROM events)"""


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, t, label, kp (array of x, y), score (array)."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    df = table(spark, sf_dir, "embeddings").select((F.col("vec_id") / 10).cast("long").alias("series"), (F.col("vec_id") % 10).cast("int").alias("t"), "label", e.alias("e"))
    kp = F.expr("transform(sequence(0, 31), i -> named_struct('x', e[2 * i], 'y', e[2 * i + 1]))")
    return df.select("series", "t", "label", kp.alias("kp"), F.expr("transform(sequence(0, 31), i -> if(abs(e[2 * i]) >= 0.02, least(1.0D, 5 * abs(e[2 * i])), 0.0D))").alias("score"))


POINTS = """points AS (SELECT vec_id // 10 AS series, CAST(vec_id % 10 AS INT) AS t, label, CAST(i AS INT) AS i, x, y, CASE WHEN abs(x) >= 0.02 THEN least(1.0, 5 * abs(x)) ELSE 0.0 END AS score
  FROM (SELECT vec_id, label, i, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y FROM (SELECT vec_id, label, embedding, unnest(range(0, 32)) AS i FROM embeddings)))"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """learner, item, ord (order within the learner), correct (null: not judged), amount."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("learner"), F.col("event_type").alias("item"), F.row_number().over(order).alias("ord"), F.when(F.col("event_type") != "error", F.col("value") > 30).alias("correct"), "value", "event_id")


ATTEMPTS = """attempts AS (SELECT user_id AS learner, event_type AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord,
  CASE WHEN event_type <> 'error' THEN value > 30 END AS correct, value, event_id FROM events)"""
