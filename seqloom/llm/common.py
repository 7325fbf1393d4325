"""Helpers that the corpus operators share: reading tables, storing results, Arrow batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark gives each task one core; the tokenizer library would start threads of its own.
os.environ["TOKENIZERS_PARALLELISM"] = "false"

#: Rows whose texts are Python objects at the same time.
STEP = 256
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers_see_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver's working folder is."""
    environment = spark.sparkContext.environment
    seen = environment.get("PYTHONPATH", "")
    if _ROOT not in seen.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, seen) if x)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where Spark runs in one process (as in tests) a folder is made if it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def discarded(spark: SparkSession, path: str) -> str:
    """The path, which is deleted when the application ends."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/seqloom-{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and survives lost executors.

    The files are deleted when the application ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    discarded(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def most_frequent(df: DataFrame, count: str, most: int) -> Column:
    """A condition on ``count`` that at most ``most`` rows of ``df`` meet, those with the largest; ties go together.

    The bound comes from how many rows have each size (in steps of a fortieth of a power of two from 40 on), a table of a few
    thousand rows at most, so no rows are sorted or gathered.
    """
    size = lambda c: F.when(c < 40, c.cast("long")).otherwise(F.floor(F.log2(c.cast("double")) * 40))
    sizes = df.groupBy(size(F.col(count)).alias("size")).agg(F.count("*").alias("n")).collect()
    seen, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["size"]):
        if seen + r["n"] > most:
            break
        seen, least = seen + r["n"], r["size"]
    return size(F.col(count)) >= least if least is not None else F.lit(False)


def held_out(doc_id: Column, divisor: int) -> Column:
    """True where crc32 of the id as text leaves 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % divisor == 2, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], step: int = STEP) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null gives an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
