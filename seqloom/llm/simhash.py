"""SimHash near-duplicates: fingerprints of word shingles, compared bit-sliced within candidate blocks.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered. Fingerprints at up to ``RADIUS`` differing bits link. The 64 bits are cut
into five ranges; three differing bits leave two ranges equal, so each of the ten pairs of ranges gives a candidate bucket and
no link is missed. A bucket of more than ``BLOCK`` fingerprints is cut into sub-blocks and every pair of sub-blocks is a cell of
its own, so no task holds a whole hot bucket and nothing is capped. Inside a block the fingerprints stand vertically, as 64
bit planes; all distances grow together in carry-save counters (ones, twos, over), and rows whose every counter has passed the
radius are abandoned. A block reports a forest of its links, not all pairs; alternating stars then join the forests.

Null, empty and blank texts have fingerprint zero, which links like any other. Fewer words than a shingle make one shingle. Equal rows
get equal results, a bit with exactly half of the shingles is 0, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import as_bytes, record_batch, slices, stored, table, workers_see_package
from seqloom.llm.graph import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints in a sub-block, and at least in one comparison (small cells are packed together).
BLOCK, PACK = 1024, 512
#: First bit and width of the ranges.
RANGES = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprint(text: bytes, width: int = SHINGLE) -> bytes:
    """Eight bytes, most significant bit first: a bit is 1 if more than half of the shingles' XXH64 have it."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return bytes(8)
    shingles = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    digests = b"".join([xxh64_digest(b" ".join(s), SEED) for s in shingles])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes()


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for each row of ``docs`` (doc_id, text); ids are long, or binary as they are."""
    workers_see_package(docs.sparkSession)
    digest = docs.schema["doc_id"].dataType.typeName() == "binary"
    kind = "binary" if digest else "long"
    schema = pa.schema([("doc_id", pa.binary() if digest else pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            marks = b"".join(fingerprint(t, width) for t in as_bytes(part.column("text")))
            yield record_batch(schema, part.column("doc_id"), np.frombuffer(marks, ">i8").astype(np.int64))

    return docs.select(F.col("doc_id").cast(kind).alias("doc_id"), "text").mapInArrow(run, f"doc_id {kind}, fp long")


def links_in_block(marks: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), i < j, of the fingerprints (uint64) at up to ``radius`` (at most 3) differing bits."""
    n = len(marks)
    bits = np.unpackbits(marks.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    planes = np.ascontiguousarray(np.packbits(np.pad(bits.T, ((0, 0), (0, -n % 64))), axis=1)).view(np.uint64)  # 64 planes, a bit for each column
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    beyond = np.packbits(np.pad(np.zeros(n, np.uint8), (0, -n % 64), constant_values=1)).view(np.uint64)  # the padding is over
    rows = np.arange(n)
    ones = np.zeros((n, planes.shape[1]), np.uint64)
    twos, over = ones.copy(), np.repeat(beyond[None, :], n, axis=0)  # over: four or more differ
    for at in range(64):
        flip = np.where(bits[rows, at] == 1, full, np.uint64(0))[:, None]
        differs = planes[at][None, :] ^ flip
        carry = ones & differs
        ones ^= differs
        over |= twos & carry
        twos ^= carry
        if at % 8 == 7 and at >= 23:
            alive = ~(over == full).all(axis=1)
            if not alive.all():
                rows, ones, twos, over = rows[alive], ones[alive], twos[alive], over[alive]
            if not len(rows):
                break
    counted = over | (twos & ones if radius == 2 else twos if radius == 1 else twos | ones if radius == 0 else np.uint64(0))
    near = np.unpackbits(np.ascontiguousarray(~counted).view(np.uint8), axis=1)[:, :n] if len(rows) else np.zeros((0, n), np.uint8)
    i, j = np.nonzero(near)
    i = rows[i]
    return i[i < j], j[i < j]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index linked with each index."""
    label = np.arange(n)
    while True:
        was = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == was).all():
            return label


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweep rows (cell, fp) that stand together by cell; whole cells are packed into blocks of ``PACK`` or more."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def block(marks: np.ndarray) -> pa.RecordBatch:
        marks = np.unique(marks)
        label = forest(len(marks), *links_in_block(marks.view(np.uint64)))
        moved = np.flatnonzero(label != np.arange(len(marks)))
        return record_batch(schema, marks[moved], marks[label[moved]])

    waiting, cells = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        cells = np.concatenate([cells, batch.column(0).to_numpy(zero_copy_only=False)])
        waiting = np.concatenate([waiting, batch.column(1).to_numpy(zero_copy_only=False)])
        starts = np.flatnonzero(np.diff(cells, prepend=cells[0] - 1 if len(cells) else 0))
        at = 0
        for s in starts[1:]:
            if s - at >= PACK:
                yield block(waiting[at:s])
                at = s
        waiting, cells = waiting[at:], cells[at:]
    if len(waiting):
        yield block(waiting)


def links(distinct: DataFrame) -> DataFrame:
    """Edges a, b that join all fingerprints of ``distinct`` (fp) within the radius, as forests of the compared blocks."""
    pairs = list(combinations(range(len(RANGES)), 2))
    piece = lambda k: F.shiftrightunsigned("fp", RANGES[k][0]).bitwiseAND((1 << RANGES[k][1]) - 1)
    keys = [F.shiftleft(F.shiftleft(piece(p), 13).bitwiseOR(piece(q)), 4).bitwiseOR(F.lit(i)) for i, (p, q) in enumerate(pairs)]
    buckets = distinct.select("fp", F.explode(F.array(*[k.cast("long") for k in keys])).alias("bucket"))
    counted = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    cut = buckets.join(counted.hint("merge"), "bucket").withColumn("g", F.ceil(F.col("n") / BLOCK).cast("int"))
    cut = cut.withColumn("s", F.expr("cast(pmod(xxhash64(fp), g) as int)")).withColumn("t", F.explode(F.expr("sequence(0, g - 1)")))
    cells = cut.select(F.expr("if(g = 1, bucket, xxhash64(bucket, least(s, t), greatest(s, t)))").alias("cell"), "fp")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links) for each row of ``docs``.

    Exact copies share a fingerprint and are compared once. An empty table gives an empty result; null ids are kept and never
    name a component that has other ids. Joins are merged: Spark takes a table for as large as its files, whatever is exploded from it
    and however well they are packed, and would send millions of fingerprints through the driver.
    """
    marked = stored(fingerprints(docs, width), "simhash")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fp")
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_mark = rooted.join(named.hint("merge"), "root").select("fp", "component_id")
    joined = marked.join(of_mark.hint("merge"), "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
