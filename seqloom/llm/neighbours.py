"""Exact nearest neighbours by cosine: a block matrix join whose tiles are products of int8 codes.

Vectors are cut into blocks. A vector of a block is kept as given and as codes -127 to 127 of its direction, with the scale and the length of the error that the codes make.
Query blocks and data blocks meet in the cells of a grid (groups of queries by groups of data blocks); a cell holds its queries and lets data
blocks pass one at a time. The product of the codes (exact: float32 holds whole numbers to 2^24, longer vectors are summed in pieces) is at most
``bound = e_q + (1 + e_q) e_d`` away from the cosine. A pair survives if its upper bound reaches the k-th largest lower bound, or score, that its query has
met so far; survivors are computed again in double precision from the vectors as given, and each query keeps its best in a heap. The cells' heaps are merged by
a ranking of k rows for each query and cell. Nothing is approximate and nothing is capped. Of equal vectors in one block only those that can be among the k first (at most k
smaller ids before them) are compared: of a vector that a third of the rows share, a block of 1,024 rows keeps k + 1.

Vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without an id. Vectors meet vectors of their own
length only. A query is not compared with rows of its own id; repeated query rows have results of their own, repeated data rows are candidates of their own. Ties rank by id. A query without candidates has no
row. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.llm.common import record_batch, stored, table, workers_see_package

NEAREST, EVERY = 5, 50
#: Rows of a data block, numbers in a block at most, queries of a group, data rows of a cell, cells that there should be (if blocks suffice).
ROWS, NUMBERS, QUERIES, CELL, CELLS = 1024, 1 << 18, 2048, 1 << 20, 64
#: Tasks that share the cells at most.
TASKS = 20_000
#: Length of vectors whose products of codes add up exactly in float32; slack for rounding of bounds; survivors computed at a time.
EXACT, SLACK, AT_ONCE = 1040, 1e-9, 1 << 15

BLOCK = "dim int, place long, n int, ids binary, scales binary, errors binary, codes binary, given binary"
_BLOCK = pa.schema([("dim", pa.int32()), ("place", pa.int64()), ("n", pa.int32())] + [(c, pa.binary()) for c in ("ids", "scales", "errors", "codes", "given")])


def usable(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """vec_id, v (array of double) of the rows that take part."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(finite & F.exists("v", lambda x: x != 0))


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and error lengths of the directions of ``vectors``."""
    unit = vectors / lengths(vectors)[:, None]
    scales = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scales[:, None]).astype(np.int8)
    return codes, scales, np.sqrt(((unit - codes * scales[:, None]) ** 2).sum(axis=1))


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def balanced(vectors: np.ndarray) -> np.ndarray:
    """The vectors times powers of two that bring their largest component near 1, so that squares neither vanish nor overflow; exact."""
    _, power = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -power[:, None])


def _first_of_equals(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Index of the rows that have at most ``k`` different smaller ids among the rows with the same vector."""
    _, same = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    i, s = ids[order], same[order]
    fresh = np.append(True, s[1:] != s[:-1])
    number = np.cumsum(fresh | np.append(True, i[1:] != i[:-1]))
    first = np.maximum.accumulate(np.where(fresh, number, 0))
    return np.sort(order[number - first <= k])


def blocks(vectors: DataFrame, k: int | None) -> DataFrame:
    """The vectors (vec_id, v) in blocks of one dimension; ``place`` tells partition and number. With ``k``, equal vectors that cannot be among the k first are left out."""
    workers_see_package(vectors.sparkSession)

    def packed(dim: int, place: int, ids: list[int], rows: list) -> pa.RecordBatch:
        ids, v = np.array(ids, np.int64), balanced(np.stack(rows) + 0.0)
        if k is not None:
            chosen = _first_of_equals(ids, v, k)
            ids, v = ids[chosen], v[chosen]
        codes, scales, errors = quantised(v)
        return record_batch(_BLOCK, [dim], [place], [len(ids)], *([x.tobytes()] for x in (ids, scales, errors, codes, v)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}
        place = TaskContext.get().partitionId() << 32
        for batch in batches:
            lists = batch.column("v")
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            for vec_id, s, e in zip(batch.column("vec_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                ids, rows = waiting.setdefault(e - s, ([], []))
                ids.append(vec_id)
                rows.append(flat[s:e])
                if len(ids) >= max(1, min(ROWS, NUMBERS // (e - s))):
                    yield packed(e - s, place, ids, rows)
                    place += 1
                    del waiting[e - s]
        for dim, (ids, rows) in waiting.items():
            yield packed(dim, place, ids, rows)
            place += 1

    return vectors.mapInArrow(run, BLOCK)


class Block:
    """A block as arrays."""

    def __init__(self, row: dict):
        n, dim = row["n"], row["dim"]
        self.dim, self.place = dim, row["place"]
        self.ids, self.scales, self.errors = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["scales"]), np.frombuffer(row["errors"])
        self.codes = np.frombuffer(row["codes"], np.int8).reshape(n, dim).astype(np.float32)
        self.given = np.frombuffer(row["given"]).reshape(n, dim)
        self.lengths = lengths(self.given)


class Nearest:
    """The best so far of a block of queries."""

    def __init__(self, queries: Block, k: int):
        self.queries, self.k = queries, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in queries.ids]
        self.least = np.full(len(queries.ids), -np.inf)

    def meet(self, data: Block) -> int:
        """Compare with a data block; returns how many pairs were computed in double precision."""
        q, k = self.queries, self.k
        product = np.zeros((len(q.ids), len(data.ids)))
        for at in range(0, q.dim, EXACT):
            product += q.codes[:, at : at + EXACT] @ data.codes[:, at : at + EXACT].T
        product *= q.scales[:, None]
        product *= data.scales
        bound = q.errors[:, None] + (1 + q.errors[:, None]) * data.errors + SLACK
        own = q.ids[:, None] == data.ids
        product[own] = -np.inf
        if data.ids.size > k:
            lower = product - bound
            self.least = np.maximum(self.least, np.partition(lower, -k, axis=1)[:, -k])
        i, j = np.nonzero((product + bound >= self.least[:, None]) & ~own)
        for at in range(0, len(i), AT_ONCE):
            a, b = i[at : at + AT_ONCE], j[at : at + AT_ONCE]
            score = (q.given[a] * data.given[b]).sum(axis=1) / (q.lengths[a] * data.lengths[b])
            for row, pair in zip(a.tolist(), zip(score.tolist(), (-data.ids[b]).tolist(), strict=True), strict=True):
                heap = self.heaps[row]
                if len(heap) < k:
                    heapq.heappush(heap, pair)
                elif pair > heap[0]:
                    heapq.heapreplace(heap, pair)
        full = np.array([h[0][0] if len(h) == k else -np.inf for h in self.heaps])
        self.least = np.maximum(self.least, full - SLACK)
        return len(i)


def _cells(k: int):
    """Sweep rows of blocks that stand together by cell, the queries first."""
    out = pa.schema([("place", pa.int64()), ("query", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def results(held: dict[int, list[Nearest]]) -> Iterator[pa.RecordBatch]:
        for near in (x for xs in held.values() for x in xs):
            rows = [(near.queries.place, i, int(near.queries.ids[i]), -pair[1], pair[0]) for i, heap in enumerate(near.heaps) for pair in heap]
            if rows:
                yield record_batch(out, *(list(c) for c in zip(*rows, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["cell"] != cell:
                    yield from results(held)
                    cell, held = row["cell"], {}
                if row["data"] == 0:
                    block = Block(row)
                    held.setdefault(block.dim, []).append(Nearest(block, k))
                elif row["dim"] in held:
                    block = Block(row)
                    for near in held[row["dim"]]:
                        near.meet(block)
        yield from results(held)

    return run


def nearest(data: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` (vec_id, v) its ``k`` nearest rows of ``data`` (vec_id, v), nearest first."""
    n_queries = queries.count()
    groups = max(1, -(-n_queries // QUERIES))
    packed = stored(blocks(data, k), "vector-blocks")
    asked = stored(blocks(queries.repartition(groups), None), "query-blocks")
    totals = packed.agg(F.count("*").alias("blocks"), F.sum("n").alias("rows")).first()
    parts = max(-(-(totals["rows"] or 0) // CELL), min(totals["blocks"], -(-CELLS // groups)), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    names = [f.name for f in asked.schema]
    sides = asked.select(*names, F.lit(0).alias("data"), F.shiftright("place", 32).cast("int").alias("g"), every(parts).alias("part"))
    # blocks take turns in the parts
    turn = F.pmod(F.xxhash64("place"), F.lit(parts)).cast("int")
    sides = sides.union(packed.select(*names, F.lit(1).alias("data"), every(groups).alias("g"), turn.alias("part")))
    cells = sides.withColumn("cell", F.col("g").cast("long") * parts + F.col("part")).drop("g", "part")
    found = cells.repartition(min(groups * parts, TASKS), "cell").sortWithinPartitions("cell", "data").mapInArrow(_cells(k), "place long, query int, query_id long, vec_id long, score double")
    best = F.row_number().over(W.partitionBy("place", "query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP12_SQL = f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(c.e, c.e))) AS score
  FROM u q JOIN u c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= {NEAREST}"""
