"""Sequence matching: DTW distances and paths, ranking, alignment, CTC decoding, edit distance.

A sequence table has one row for each series with ``seq``, an array of frames in order (an array of doubles each). Distances run
in Arrow batches: pairs of the same shape are computed together, cell by cell, in numpy over the whole batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators import geometry, signal
from seqloom.sources.package import ship

#: Cells of cost matrices that are computed together.
CELLS = 2_000_000


def sequences(frames: DataFrame, feature: Column, *keep: str) -> DataFrame:
    """series, seq and other columns that are constant in a series."""
    g = frames.select("series", *keep, F.struct("t", feature.alias("f")).alias("_x")).groupBy("series", *keep)
    return g.agg(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["f"]).alias("seq"))


def costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances (pairs, n, m) of frames, in float64."""
    sq = (a * a).sum(axis=2)[:, :, None] + (b * b).sum(axis=2)[:, None, :] - 2 * np.matmul(a, b.transpose(0, 2, 1))
    return np.sqrt(np.maximum(sq, 0))


def _reached(n: np.ndarray, m: np.ndarray, rows: int, columns: int, band: float) -> np.ndarray:
    """Cells (pairs, rows, columns) that the band of each pair of lengths reaches."""
    i, j = np.arange(1, rows + 1)[None, :, None], np.arange(1, columns + 1)[None, None, :]
    centre = i * (m / n)[:, None, None]
    return (j >= np.maximum(1, np.trunc(centre - band))) & (j <= np.minimum(m[:, None, None], np.trunc(centre + band) + 1))


def tables(cost: np.ndarray) -> np.ndarray:
    """Cumulated costs over steps up, diagonal and left: (n + m + 1, n + 1, pairs), cell (i, j) at [i + j, i].

    All cells of one anti-diagonal of all pairs are computed together. Cells that must not be used have an infinite cost.
    """
    pairs, n, m = cost.shape
    step = np.full((n + m + 1, n + 1, pairs), np.inf)
    i, j = np.arange(1, n + 1)[:, None], np.arange(1, m + 1)[None]
    step[i + j, i] = cost.transpose(1, 2, 0)
    dp = np.full((n + m + 1, n + 1, pairs), np.inf)
    dp[0, 0] = 0
    for d in range(2, n + m + 1):
        one, two = dp[d - 1], dp[d - 2]
        dp[d, 1:] = step[d, 1:] + np.minimum(np.minimum(one[:-1], one[1:]), two[:-1])
    return dp


def backtrace(dp: np.ndarray, n: int, m: int) -> list[tuple[int, int]]:
    """The path to (n, m) of one pair's table in increasing order; of equal steps the diagonal wins, then up."""
    i, j = n, m
    path = []
    while i and j:
        path.append((i - 1, j - 1))
        ways = ((dp[i + j - 2, i - 1], 0, (i - 1, j - 1)), (dp[i + j - 1, i - 1], 1, (i - 1, j)), (dp[i + j - 1, i], 2, (i, j - 1)))
        i, j = min(ways)[2]
    return path[::-1]


def _padded(sequences: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(sequences), max(map(len, sequences)), width))
    for r, x in enumerate(sequences):
        out[r, : len(x)] = x
    return out


def warp(left: list[np.ndarray], right: list[np.ndarray], band: float | None = None, paths: bool = False) -> tuple[np.ndarray, list]:
    """Distance (cost over n + m) and, if asked for, path of each pair; pairs of about the same lengths are padded and computed together."""
    distance, found = np.full(len(left), np.inf), [[] for _ in left]
    order = sorted((r for r in range(len(left)) if len(left[r]) and len(right[r])), key=lambda r: (len(left[r]), len(right[r])))
    at = 0
    while at < len(order):
        to, n, m = at, 0, 0
        while to < len(order):
            wider = max(n, len(left[order[to]])), max(m, len(right[order[to]]))
            if to > at and (to + 1 - at) * wider[0] * wider[1] > CELLS:
                break
            (n, m), to = wider, to + 1
        some, at = order[at:to], to
        a, b = ([np.asarray(side[r], float).reshape(len(side[r]), -1) for r in some] for side in (left, right))
        ns, ms = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        cost = costs(_padded(a, a[0].shape[1]), _padded(b, a[0].shape[1]))
        if band is not None:
            cost[~_reached(ns, ms, n, m, band)] = np.inf
        dp = tables(cost)
        ends = dp[ns + ms, ns, np.arange(len(some))]
        distance[some] = ends / (ns + ms)
        if paths:
            for k, r in enumerate(some):
                if np.isfinite(ends[k]):
                    found[r] = [{"i": i, "j": j} for i, j in backtrace(dp[:, :, k], int(ns[k]), int(ms[k]))]
    return distance, found


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.array(x if x is not None else [], float) for x in column.to_pylist()]


def align(pairs: DataFrame, band: float | None = None, paths: bool = False) -> DataFrame:
    """``pairs`` (any keys, arrays a and b) without a and b, with distance (cost over n + m) and, if asked for, path (array of i, j).

    An empty sequence, or an end that the band doesn't reach, gives an infinite distance and an empty path.
    """
    ship(pairs.sparkSession)
    keys = [c for c in pairs.columns if c not in ("a", "b")]
    step = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distance, path = warp(_arrays(batch.column("a")), _arrays(batch.column("b")), band, paths)
            columns = [batch.column(c) for c in keys] + [pa.array(distance, pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(path, step)] if paths else [])], [*keys, "distance", *(["path"] if paths else [])])

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", distance double" + (", path array<struct<i: int, j: int>>" if paths else "")
    return pairs.mapInArrow(run, schema)


def scalar_dtw(a: str, b: str) -> Column:
    """DTW distance of two array columns of doubles as a fold over anti-diagonals, without Python; each step makes one new array."""
    return F.expr(scalar_dtw_sql(a, b))


def scalar_dtw_sql(a: str, b: str) -> str:
    n, m = f"size({a})", f"size({b})"
    cell = f"if(i >= 1 and d - i between 1 and {m}, abs({a}[i - 1] - {b}[d - i - 1]) + least(s.one[i - 1], s.one[i], s.two[i - 1]), double('inf'))"
    first = f"named_struct('two', transform(sequence(0, {n}), i -> if(i = 0, 0.0D, double('inf'))), 'one', transform(sequence(0, {n}), i -> double('inf')))"
    fold = f"aggregate(sequence(2, {n} + {m}), {first}, (s, d) -> named_struct('two', s.one, 'one', transform(sequence(0, {n}), i -> {cell})), s -> s.one[{n}] / ({n} + {m}))"
    return f"if({n} = 0 or {m} = 0, double('inf'), {fold})"


def cost_matrix(pairs: DataFrame) -> DataFrame:
    """keys, i, j, cost of every pair of frames, as expressions."""
    keys = [c for c in pairs.columns if c not in ("a", "b")]
    df = pairs.select(*keys, "b", F.posexplode("a").alias("i", "x")).select(*keys, "i", "x", F.posexplode("b").alias("j", "y"))
    return df.select(*keys, "i", "j", F.expr("sqrt(aggregate(zip_with(x, y, (u, v) -> (u - v) * (u - v)), 0.0D, (s, d) -> s + d))").alias("cost"))


def _blocks(queries: DataFrame, bank: DataFrame, targets: DataFrame | None, block: int) -> DataFrame:
    """Queries (ask) and bank series that meet, as rows of groups (of, part, slot) of a bounded number of sequences.

    The bank is cut into blocks of about ``block`` series, of one label each where ``targets`` (label_q, label) restricts the
    labels that a query meets; queries go to the blocks that they meet, by an equi-join on the label. A block with many queries is
    dealt to several tasks, so a group has a bounded number of sequences whatever the sizes.
    """
    ship(queries.sparkSession)
    ask = queries.select(F.col("series").alias("query"), F.col("label").alias("label_q"), "seq")
    if targets is None:
        parts, shares = (max(1, -(-df.count() // block)) for df in (bank, queries))
        met = ask.withColumns({"of": F.lit(0), "parts": F.lit(parts), "shares": F.lit(shares)})
        held = bank.withColumns({"of": F.lit(0), "parts": F.lit(parts), "shares": F.lit(shares)})
    else:
        # a row for each label
        many = lambda df, name: df.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
        meeting = ask.select("label_q").join(targets, "label_q")
        cut = many(bank, "parts").join(many(meeting, "shares"), "label").withColumnRenamed("label", "of")
        met = ask.join(targets.withColumnRenamed("label", "of"), "label_q").join(cut, "of")
        held = bank.join(cut, bank["label"] == cut["of"])
    met = met.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("slot", F.expr("cast(pmod(xxhash64(query), shares) as int)"))
    met = met.select("of", "part", "slot", F.col("query").alias("series"), F.col("label_q").alias("label"), "seq", F.lit(True).alias("ask"))
    held = held.withColumn("part", F.expr("cast(pmod(xxhash64(series), parts) as int)")).withColumn("slot", F.explode(F.expr("sequence(0, shares - 1)")))
    held = held.select("of", "part", "slot", "series", "label", "seq", F.lit(False).alias("ask"))
    return met.unionByName(held)


def _group(table: pa.Table, others: bool) -> tuple[pa.Table, list[np.ndarray], np.ndarray, np.ndarray]:
    """A group's rows, its sequences, and the pairs (row of a query, row of a series) that meet in it."""
    rows = table.combine_chunks()
    asks = rows.column("ask").to_numpy().astype(bool)
    sequences = [np.array(x if x is not None else [], float) for x in rows.column("seq").to_pylist()]
    ids = rows.column("series").to_pylist()
    q, r = np.flatnonzero(asks), np.flatnonzero(~asks)
    i, j = np.repeat(q, len(r)), np.tile(r, len(q))
    if others:
        keep = np.fromiter((ids[x] != ids[y] for x, y in zip(i, j, strict=True)), bool, len(i))
        i, j = i[keep], j[keep]
    return rows, sequences, i, j


def distances(queries: DataFrame, bank: DataFrame, band: float | None = None, targets: DataFrame | None = None, others: bool = False, block: int = 256) -> DataFrame:
    """query, label_q, series, label, distance of each query (series, label, seq) and each series of the bank that it meets (see ``_blocks``).

    Every pair is a row: where only the nearest of each label count, ``nearest`` does less. ``others``: a query does not meet itself.
    """
    kinds = [bank.schema[c].dataType.simpleString() for c in ("series", "label")]

    def run(key, table):
        rows, sequences, i, j = _group(table, others)
        distance, _ = warp([sequences[x] for x in i], [sequences[y] for y in j], band)
        series, label = rows.column("series"), rows.column("label")
        return pa.table([series.take(pa.array(i)), label.take(pa.array(i)), series.take(pa.array(j)), label.take(pa.array(j)), pa.array(distance, pa.float64())], names=["query", "label_q", "series", "label", "distance"])

    return _blocks(queries, bank, targets, block).groupBy("of", "part", "slot").applyInArrow(run, f"query {kinds[0]}, label_q {kinds[1]}, series {kinds[0]}, label {kinds[1]}, distance double")


def ends_within(cost: np.ndarray, ns: np.ndarray, ms: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Cumulated cost of each pair's best path, infinite where it would be above ``limit``.

    ``cost`` (pairs, n, m) is padded; a pair is given up when nothing on two successive anti-diagonals, which every path touches, is within its limit.
    """
    pairs, n, m = cost.shape
    out = np.full(pairs, np.inf)
    live = np.arange(pairs)
    two, one = np.full((pairs, n + 1), np.inf), np.full((pairs, n + 1), np.inf)
    two[:, 0] = 0
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        now = np.full((len(live), n + 1), np.inf)
        now[:, i] = cost[:, i - 1, d - i - 1] + np.minimum(np.minimum(one[:, i - 1], one[:, i]), two[:, i - 1])
        done = ns[live] + ms[live] == d
        out[live[done]] = now[done, ns[live[done]]]
        two, one = one, now
        going = ~done & (np.minimum(one.min(axis=1), two.min(axis=1)) <= limit[live])
        if going.sum() <= len(live) * 0.75 or d == n + m:
            live, two, one, cost = live[going], two[going], one[going], cost[going]
        elif done.any():
            one[done] = two[done] = np.inf
        if not len(live):
            break
    return np.where(out <= limit, out, np.inf)


class _Nearest:
    """The smallest distance of each query and label of a group, found by bounds of growing cost.

    A path passes each frame of either side, the first two together and the last two together. So its cost is at least that of the first and
    last pairs plus, for each frame between, its distance to the ball about the other series' frames (their mean, and the radius that holds
    them); and at least the sum over frames of the smallest cost in their row, or column, of the cost matrix. The series of a label are taken in order of the first
    bound, in rounds of growing size: those that can't be below the best so far are dropped by the first bound, then by the second, then while the
    cumulated costs grow.
    """

    def __init__(self, sequences: list[np.ndarray], band: float | None):
        self.sequences, self.band, self.computed = sequences, band, 0
        self.mean = [x.mean(axis=0) if len(x) else None for x in sequences]
        self.radius = [float(np.sqrt(((x - c) ** 2).sum(axis=1)).max()) if len(x) else 0.0 for x, c in zip(sequences, self.mean, strict=True)]

    def bounds(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """First bound of the pairs, as a cost."""
        out = np.zeros(len(i))
        right = np.unique(j)
        place = {r: k for k, r in enumerate(right.tolist())}
        heads, tails, means = (np.stack([pick(r) for r in right]) for pick in (lambda r: self.sequences[r][0], lambda r: self.sequences[r][-1], lambda r: self.mean[r]))
        radius = np.array([self.radius[r] for r in right])
        to = np.array([place[r] for r in j.tolist()])
        for q in np.unique(i):
            mine, x = i == q, self.sequences[q]
            total = np.sqrt(((heads - x[0]) ** 2).sum(axis=1))
            if len(x) > 1:
                total = total + np.sqrt(((tails - x[-1]) ** 2).sum(axis=1))
            if len(x) > 2:
                away = np.sqrt(np.maximum((x[1:-1] ** 2).sum(axis=1)[:, None] + (means**2).sum(axis=1) - 2 * x[1:-1] @ means.T, 0))
                total = total + np.maximum(away - radius, 0).sum(axis=0)
            out[mine] = total[to[mine]]
        return out

    def refined(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Exact costs of the pairs where they are within ``limit``, else infinite."""
        out = np.full(len(i), np.inf)
        ns, ms = (np.array([len(self.sequences[x]) for x in side]) for side in (i, j))
        order = np.lexsort((ms, ns))
        at = 0
        while at < len(order):
            n = m = 0
            to, width = at, self.sequences[i[order[at]]].shape[1]
            while to < len(order):
                wider = max(n, ns[order[to]]), max(m, ms[order[to]])
                # the frames of both sides are more numbers than their costs
                if to > at and (to + 1 - at) * (wider[0] * wider[1] + sum(wider) * width) > CELLS:
                    break
                (n, m), to = wider, to + 1
            some, at = order[at:to], to
            cost = costs(_padded([self.sequences[x] for x in i[some]], width), _padded([self.sequences[x] for x in j[some]], width))
            inside = (np.arange(n)[None, :, None] < ns[some][:, None, None]) & (np.arange(m)[None, None, :] < ms[some][:, None, None])
            bare = np.where(inside, cost, np.inf)
            rows, columns = (np.where(np.isfinite(x := bare.min(axis=axis)), x, 0).sum(axis=1) for axis in (2, 1))
            close = np.maximum(rows, columns) <= limit[some] * (1 + 1e-9)
            some, cost = some[close], cost[close]
            self.computed += len(some)
            if not len(some):
                continue
            if self.band is not None:
                cost[~_reached(ns[some], ms[some], n, m, self.band)] = np.inf
            out[some] = ends_within(cost, ns[some], ms[some], limit[some] * (1 + 1e-9))
        return out

    def best(self, i: np.ndarray, j: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
        """Smallest distance (cost over n + m) of each group of pairs."""
        size = np.array([len(self.sequences[a]) + len(self.sequences[b]) for a, b in zip(i, j, strict=True)])
        whole = np.array([bool(len(self.sequences[a]) and len(self.sequences[b])) for a, b in zip(i, j, strict=True)], bool)
        best = np.full(groups, np.inf)
        i, j, group, size = i[whole], j[whole], group[whole], size[whole]
        if not len(i):
            return best
        bound = self.bounds(i, j)
        order = np.lexsort((bound / size, group))
        i, j, group, size, bound = (x[order] for x in (i, j, group, size, bound))
        take = 1
        while len(i):
            first = np.append(True, group[1:] != group[:-1])
            number = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
            now = number < take
            cost = self.refined(i[now], j[now], best[group[now]] * size[now])
            np.minimum.at(best, group[now], cost / size[now])
            left = ~now
            left[left] = bound[left] / size[left] <= best[group[left]] * (1 + 1e-9)
            i, j, group, size, bound, take = i[left], j[left], group[left], size[left], bound[left], take * 4
        return best


def nearest(queries: DataFrame, bank: DataFrame, band: float | None = None, targets: DataFrame | None = None, others: bool = False, block: int = 256) -> DataFrame:
    """query, label_q, label, distance, met, computed: the smallest distance to each label's series, exactly (see ``_Nearest``).

    A task hands on a row for each query and label; ``met`` pairs were there, for ``computed`` of them cumulated costs were begun. ``others``: a query does not meet itself.
    """
    kinds = [bank.schema[c].dataType.simpleString() for c in ("series", "label")]

    def run(key, table):
        rows, sequences, i, j = _group(table, others)
        codes = rows.column("label").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        pairs, group = np.unique(np.stack([i, codes[j]]), axis=1, return_inverse=True) if len(i) else (np.zeros((2, 0), np.int64), i)
        group = group.reshape(-1)
        some = _Nearest(sequences, band)
        best = some.best(i, j, group, pairs.shape[1])
        met = np.bincount(group, minlength=pairs.shape[1])
        one = np.zeros(pairs.shape[1], np.int64)
        one[:1] = some.computed  # the task's count stands with its first row
        series, label = rows.column("series"), rows.column("label")
        example = np.zeros(pairs.shape[1], np.int64)
        example[group] = j
        columns = [series.take(pa.array(pairs[0])), label.take(pa.array(pairs[0])), label.take(pa.array(example)), pa.array(best, pa.float64()), pa.array(met, pa.int64()), pa.array(one, pa.int64())]
        return pa.table(columns, names=["query", "label_q", "label", "distance", "met", "computed"])

    found = _blocks(queries, bank, targets, block).groupBy("of", "part", "slot").applyInArrow(run, f"query {kinds[0]}, label_q {kinds[1]}, label {kinds[1]}, distance double, met long, computed long")
    return found.groupBy("query", "label_q", "label").agg(F.min("distance").alias("distance"), F.sum("met").alias("met"), F.sum("computed").alias("computed"))


def summaries(queries: DataFrame, bank: DataFrame, band: float | None = None, block: int = 256) -> DataFrame:
    """query, label_q, label, nearest, mean over all pairs; a task hands on a row for each query and label."""
    kinds = [bank.schema[c].dataType.simpleString() for c in ("series", "label")]

    def run(key, table):
        rows, sequences, i, j = _group(table, False)
        distance, _ = warp([sequences[x] for x in i], [sequences[y] for y in j], band)
        series, label = rows.column("series"), rows.column("label")
        named = pa.table([series.take(pa.array(i)), label.take(pa.array(i)), label.take(pa.array(j)), pa.array(distance, pa.float64())], names=["query", "label_q", "label", "d"])
        g = named.group_by(["query", "label_q", "label"]).aggregate([("d", "min"), ("d", "sum"), ("d", "count")])
        return g.select(["query", "label_q", "label", "d_min", "d_sum", "d_count"]).rename_columns(["query", "label_q", "label", "low", "total", "n"])

    found = _blocks(queries, bank, None, block).groupBy("of", "part", "slot").applyInArrow(run, f"query {kinds[0]}, label_q {kinds[1]}, label {kinds[1]}, low double, total double, n long")
    return found.groupBy("query", "label_q", "label").agg(F.min("low").alias("nearest"), (F.sum("total") / F.sum("n")).alias("mean"))


def per_label(distances: DataFrame, mode: str = "min") -> DataFrame:
    """query, label_q, label, distance: nearest (or mean) distance to the references of each label."""
    return distances.groupBy("query", "label_q", "label").agg((F.min if mode == "min" else F.avg)("distance").alias("distance"))


def ranked(labels: DataFrame) -> DataFrame:
    """Adds rank by distance within each query; ties go to the smaller label."""
    return labels.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("distance", "label")))


def reference_bank(rows: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The training rows (train) of the wanted labels, feat standardised by their own columns' mean and deviation, and the labels without any."""
    bank = rows.where("train").join(wanted.select("label").distinct(), "label", "left_semi")
    missing = wanted.select("label").distinct().join(bank.select("label").distinct(), "label", "left_anti")
    return geometry.standardize(bank, geometry.fit_standardizer(bank)), missing


def first_references(bank: DataFrame, k: int) -> DataFrame:
    """The first k series of each label."""
    return bank.withColumn("_n", F.row_number().over(W.partitionBy("label").orderBy("series"))).where(F.col("_n") <= k).drop("_n")


def segments(paths: DataFrame, owner: DataFrame, keys: list[str]) -> DataFrame:
    """keys, part, start, stop: range of frames i on the path that meet the frames j of each part; ``owner`` has keys, j, part.

    A part that the path never meets gives null bounds.
    """
    steps = paths.select(*keys, F.explode("path").alias("p")).select(*keys, F.col("p.i").alias("i"), F.col("p.j").alias("j"))
    found = owner.join(steps, [*keys, "j"], "left").groupBy(*keys, "part")
    return found.agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop"))


def align_and_grade(attempt: DataFrame, reference: DataFrame, targets: DataFrame, grade: Callable[[DataFrame], DataFrame], threshold: float, preroll: int = 12, settle: int = 8) -> DataFrame:
    """series, part, parameter, start, stop, distance, predicted, target, confidence, correct: each part of a reference found in an attempt and judged.

    ``attempt`` has series, t, f (array of doubles), ``reference`` also part. The alignment path gives the range of attempt frames of each
    part; the range is cut to its motion (distance of a frame to the one before, none for its first) with ``preroll`` and ``settle``
    around it, and graded like an attempt of its own: ``grade`` takes frames (series: struct of series and part, t, f) and returns series, parameter, predicted,
    confidence. ``targets`` (series, part, parameter, target, judged) says what was wanted; correct is null where the target is not judged, for lack of support, and
    all that was found is null for a part that the path gives no frame. distance is that of the alignment as a whole.
    """
    joined = sequences(attempt, F.col("f")).withColumnRenamed("seq", "a").join(sequences(reference, F.col("f")).withColumnRenamed("seq", "b"), "series")
    paths = align(joined, paths=True)
    found = segments(paths, reference.select("series", F.col("t").alias("j"), "part"), ["series"])
    name = F.struct("series", "part", "start").alias("series")
    mine = attempt.join(found, "series").where("t >= start and t < stop").select(name, (F.col("t") - F.col("start")).alias("t"), "f")
    was = F.lag("f").over(signal.by_time())
    moved = F.sqrt(F.aggregate(F.zip_with("f", "_was", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    mine = mine.withColumn("_was", was).withColumn("energy", F.coalesce(moved, F.lit(0.0))).drop("_was")
    span = signal.capture_span(mine, threshold, preroll=preroll, settle=settle)
    at = lambda c: (F.col("series.start") + F.col(c)).cast("int").alias(c)
    places = span.select("series.series", "series.part", at("start"), at("stop"))
    judged = grade(signal.trim(mine, span).select(F.struct("series.series", "series.part").alias("series"), "t", "f"))
    judged = judged.select("series.series", "series.part", "parameter", "predicted", "confidence")
    whole = targets.join(paths.select("series", "distance"), "series").join(places, ["series", "part"], "left").join(judged, ["series", "part", "parameter"], "left")
    return whole.select("series", "part", "parameter", "start", "stop", "distance", "predicted", "target", "confidence", F.when(F.col("judged"), F.col("predicted") == F.col("target")).alias("correct"))


def compose(playlist: DataFrame, frames: DataFrame) -> DataFrame:
    """seq_id, t, part, source, feature: frames of the playlist's clips one after the other; playlist has seq_id, part, source.

    Offsets are running sums of clip lengths, so nothing is collected.
    """
    sizes = frames.groupBy(F.col("series").alias("source")).agg(F.count("*").alias("n"))
    order = W.partitionBy("seq_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    placed = playlist.join(sizes, "source").withColumn("offset", F.coalesce(F.sum("n").over(order), F.lit(0)))
    return placed.join(frames.withColumnRenamed("series", "source"), "source").withColumn("t", (F.col("offset") + F.col("t")).cast("int")).drop("n", "offset")


def greedy_decode(frames: DataFrame, scores: Column, blank: int = 0) -> DataFrame:
    """series, tokens: best class of each frame, repeats collapsed (a blank between them keeps both), blanks dropped."""
    best = F.expr("array_position(_s, array_max(_s)) - 1").cast("int")
    df = frames.withColumn("_s", scores).select("series", "t", best.alias("k"))
    was = F.lag("k").over(W.partitionBy("series").orderBy("t"))
    kept = df.withColumn("_was", was).withColumn("keep", (F.col("_was").isNull() | (F.col("_was") != F.col("k"))) & (F.col("k") != blank))
    found = F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("t", "k"))))
    return kept.groupBy("series").agg(F.transform(found, lambda x: x["k"]).alias("tokens"))


def edit_distance(a: str, b: str) -> Column:
    """Edits between two array columns, as nested folds."""
    inner = f"aggregate({b}, array(p[0] + 1), (c, y) -> concat(c, array(least(p[size(c)] + 1, c[size(c) - 1] + 1, p[size(c) - 1] + if(x = y, 0, 1)))))"
    return F.expr(f"aggregate({a}, sequence(0, size({b})), (p, x) -> {inner}, p -> p[size({b})])")


def word_error_rate(a: str, b: str) -> Column:
    """Edits over the true length; an empty truth gives 0 if the guess is empty too, else infinity."""
    return F.when(F.expr(f"size({a}) > 0"), edit_distance(a, b) / F.expr(f"size({a})")).when(F.expr(f"size({b}) = 0"), 0.0).otherwise(F.lit(float("inf")))


def forced_labels(log_probs: np.ndarray, target: list[int], blank: int = 0) -> list[int] | None:
    """Index into the target for each frame, -1 for blanks, on the best path through blank-interleaved targets; None if there are too few frames for any."""
    states = [blank]
    for k in target:
        states += [k, blank]
    n, size = len(log_probs), len(states)
    may_skip = np.array([s >= 2 and states[s] != blank and states[s] != states[s - 2] for s in range(size)])
    emit = log_probs[:, states]
    score = np.where(np.arange(size) < 2, emit[0], -np.inf)
    came = np.zeros((n, size), np.int64)  # how many states back the best way into each state starts
    for t in range(1, n):
        behind = np.concatenate([[-np.inf, -np.inf], score])
        ways = np.stack([score, behind[1:-1], np.where(may_skip, behind[:-2], -np.inf)])
        came[t] = ways.argmax(axis=0)
        score = ways.max(axis=0) + emit[t]
    ends = np.arange(size)[-2:][::-1]  # the last blank, or the last class itself; the blank wins a tie
    state = int(ends[score[ends].argmax()])
    if not np.isfinite(score[state]):
        return None
    trail = np.empty(n, np.int64)
    for t in range(n - 1, -1, -1):
        trail[t] = state
        state -= came[t, state]
    return np.where(trail % 2 == 1, trail // 2, -1).tolist()


def forced_align(rows: DataFrame, blank: int = 0) -> DataFrame:
    """series, labels of rows (series, probs: array of arrays of log probabilities, target: array of classes); null where no path fits."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [forced_labels(np.array(p, float), t, blank) if p else [] for p, t in zip(batch.column("probs").to_pylist(), batch.column("target").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("series").cast(pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["series", "labels"])

    return rows.select(F.col("series").cast("long").alias("series"), "probs", "target").mapInArrow(run, "series long, labels array<int>")


def label_segments(labels: DataFrame, parts: Column) -> DataFrame:
    """series, part, start, stop for each part from 0 on; (0, 0) for a part without a frame, no row for a series without parts."""
    want = labels.select("series", F.explode(F.when(parts > 0, F.sequence(F.lit(0), parts - 1))).alias("part"))
    have = labels.select("series", F.posexplode("labels").alias("t", "part")).where("part >= 0").groupBy("series", "part").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("stop"))
    return want.join(have, ["series", "part"], "left").select("series", "part", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("stop", F.lit(0)).alias("stop"))


def numbered(rows: DataFrame, keys: list[str], id_: str, seed: int, piece: int = 100_000) -> DataFrame:
    """``rows`` with number (0, 1, ... in an order by hash) and size within their keys.

    Rows of a key are numbered in pieces by hash, which running sums over the pieces put in line, so no key is one task.
    """
    h = F.xxhash64(F.lit(seed), id_)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("size"))
    cut = rows.join(sizes, keys).withColumn("_h", h).withColumn("_p", F.expr(f"pmod(shiftright(_h, 7), cast(ceil(size / {piece}) as long))"))
    line = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    before = cut.groupBy(*keys, "_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(line), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy(*keys, "_p").orderBy("_h", id_)) - 1
    return cut.join(before, [*keys, "_p"]).withColumn("number", F.col("_before") + inside).drop("_h", "_p", "_before")


def stratum(slot: Column, slots: int, size: Column, draw: Column) -> Column:
    """A number below ``size`` for each of ``slots`` draws: from the slot's own share of the numbers, so no number comes twice."""
    low = F.floor(slot * size / slots)
    return low + F.pmod(draw, F.floor((slot + 1) * size / slots) - low)


def sample_trials(clips: DataFrame, train: DataFrame, trials: DataFrame, k: int, seed: int) -> DataFrame:
    """trial, part, label and the columns of one clip: k different labels for each trial and one clip of each, by hashes.

    Labels are drawn among those that have clips both in ``clips`` and in ``train`` (label). Labels and the clips of a label are numbered,
    and a draw is a number that an equi-join looks up, so a trial never meets all labels or all clips of one. Fewer than k labels
    are refused.
    """
    both = clips.join(train.select("label").distinct(), "label", "left_semi")
    labels = both.select("label").distinct()
    n = labels.count()
    if n < k:
        raise ValueError(f"{k} labels for each trial, but only {n} have clips on both sides")
    labels = numbered(labels.withColumn("_all", F.lit(1)), ["_all"], "label", seed).select("label", "number")
    part = F.col("part")
    drawn = trials.withColumn("part", F.explode(F.expr(f"sequence(0, {k - 1})"))).withColumn("number", stratum(part, k, F.lit(n), F.xxhash64(F.lit(seed), "trial", part)))
    drawn = drawn.join(labels, "number").drop("number")
    clip = numbered(both, ["label"], "series", seed)
    sizes = both.groupBy("label").agg(F.count("*").alias("size"))
    pick = drawn.join(sizes, "label").withColumn("number", F.pmod(F.xxhash64(F.lit(seed), "trial", "label"), F.col("size"))).drop("size")
    return pick.join(clip.drop("size"), ["label", "number"]).drop("number").select("trial", "part", *both.columns)
