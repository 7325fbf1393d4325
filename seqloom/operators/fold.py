"""Folds over histories in order: a history of any length passes through its task in Arrow batches, and only its state is held.

The rows are dealt by key and sorted within partitions by key and order (a sort that spills), so a key's rows come one after the other
and its state goes from one batch to the next. Where steps can be joined in any grouping, ``affine`` splits a history over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqloom.sources.package import ship

#: Rows that a fold hands on together.
OUT = 4096


def arrow_schema(ddl: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl)


def fold(df: DataFrame, keys: list[str], order: list[str], values: list[str], start: Callable, step: Callable, finish: Callable | None, schema: str, each: bool = False) -> DataFrame:
    """Rows of ``schema`` made from each key's history in order.

    ``start()`` gives a state, ``step(state, *values)`` the next one; ``finish(state)`` gives the rest of each result row of a key (a list of
    tuples that follow the key). With ``each``, ``step`` gives (state, tuple) and every row of the history has a result row.
    """
    ship(df.sparkSession)
    n = len(keys)
    rows = df.select(*dict.fromkeys([*keys, *values, *order])).repartition(*keys).sortWithinPartitions(*keys, *order)
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * len(out_schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

        key, state = None, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in [*keys, *values]), strict=True):
                if row[:n] != key:
                    if key is not None and finish:
                        out += [(*key, *r) for r in finish(state)]
                    key, state = row[:n], start()
                if each:
                    state, told = step(state, *row[n:])
                    out.append((*key, *told))
                else:
                    state = step(state, *row[n:])
                if len(out) >= OUT:
                    yield flushed()
                    out.clear()
        if key is not None and finish:
            out += [(*key, *r) for r in finish(state)]
        yield flushed()

    return rows.mapInArrow(run, schema)


def affine(df: DataFrame, keys: list[str], order: list[str], value: str, keep: float, start: float, block: Column | None = None) -> DataFrame:
    """keys, value, n: from ``start``, each row in order makes x into ``keep * x + (1 - keep) * value``.

    Such steps join to steps of the same kind: n rows are ``keep^n x + b``. A long history is dealt to many tasks, by ranges of key and order, or by key and ``block`` where
    that is given (a number that does not fall in the order; it saves looking at the rows for ranges first). Each task joins what it has of a key, and the
    pieces, a row for each key and task or block, are joined by a sum, weighted by the rows that come after.
    """
    ship(df.sparkSession)
    rows = df.select(*keys, *order, F.col(value).cast("double").alias("_v"), (block if block is not None else F.lit(0)).cast("long").alias("_piece"))
    if block is not None:
        rows = rows.repartition(*keys, "_piece").sortWithinPartitions(*keys, "_piece", *order)
    else:
        rows = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_piece", F.spark_partition_id().cast("long"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, _piece long, _n long, _b double"
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*((*name, n, b) for name, n, b in found), strict=True)) if found else [()] * len(out_schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

        held: tuple | None = None  # key and piece, rows, b of what the last batch ended with
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(k).to_pylist() for k in [*keys, "_piece"]), strict=True))
            v = batch.column("_v").to_numpy(zero_copy_only=False)
            starts = np.array([0] + [i for i in range(1, len(names)) if names[i] != names[i - 1]])
            ends = np.append(starts[1:], len(names))
            after = np.repeat(ends, ends - starts) - 1 - np.arange(len(names))
            b = np.add.reduceat((1 - keep) * v * keep**after, starts)
            found = [(names[s], e - s, x) for s, e, x in zip(starts.tolist(), ends.tolist(), b.tolist(), strict=True)]
            if held and held[0] == found[0][0]:
                found[0] = (held[0], held[1] + found[0][1], keep ** found[0][1] * held[2] + found[0][2])
            elif held:
                found.insert(0, held)
            held = found.pop()
            yield told(found)
        yield told([held] if held else [])

    pieces = rows.mapInArrow(run, schema)
    later = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy(F.desc("_piece")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    weighted = pieces.withColumn("_w", F.pow(F.lit(keep), later.cast("double")))
    n = F.sum("_n")
    return weighted.groupBy(*keys).agg((F.lit(start) * F.pow(F.lit(keep), n.cast("double")) + F.sum(F.col("_w") * F.col("_b"))).alias(value), n.alias("n"))
