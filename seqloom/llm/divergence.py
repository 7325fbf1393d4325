"""Source divergence audit: how far the word use of each source of a language is from that of the others and of the language.

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lowered; a language keeps the V terms that at least ``LEAST`` of its documents have. A group
(language and source, or the whole language) gives a kept term ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))``, N being its count of kept terms, and
two groups differ at a term by ``f = floor((p - q)^2 / (p + q))``.

A pair of sources sums f over all kept terms. Most counts are 0, so the sum starts from V times f of two zeros, and only terms that a source has correct
it: a term that has s gives f(p_s, t's zero) - f(s's zero, t's zero) for every t, added up by the values of p that occur; where a term has s and t, the
rest ``f(p_s, p_t) - f(p_s, 0_t) - f(0_s, p_t) + f(0_s, 0_t)`` is due. For these, a term is a row of its sources, in order, with their p. Equal rows are counted once with their
multiplicity, and the rows, sorted over the cluster, are inserted in frequent-pattern trees of up to ``TREE`` rows: what rows begin with alike is one path, and each
node adds the rest of each of its ancestors once, times its multiplicity. All numbers are integers; the sums are exact in any order.

The groups of a language meet each other because the result has a row for each pair of its sources. Counting is combined in the map; a source with a third of all rows is never gathered.

Null text, lang and source are ''. Repeated rows count as documents of their own. Texts without terms still make their group occur; with no kept term a pair's value is 0. Ties rank by item. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.common import as_bytes, record_batch, slices, stored, table, workers_see_package

#: Documents that must have a kept term; terms listed for each group.
LEAST, TOP = 10, 10
#: Counts that a task holds before it hands them on; rows of a tree, and their nodes at most.
HELD, TREE, NODES = 1 << 18, 1 << 16, 1 << 20
#: A byte of a character above 0x7F is above 0x7F, too, so bytes do for characters.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: partial counts of the terms of ``docs`` (text, lang, source); every group has a row with a null term."""
    workers_see_package(docs.sparkSession)
    out = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            yield record_batch(out, [lang], [source], [None], [0], [0])
            if n:
                k = len(n)
                yield record_batch(out, [lang] * k, [source] * k, pa.array(list(n), pa.binary()).cast(pa.string()), list(n.values()), [d[t] for t in n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for part in slices(batches):
            for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), as_bytes(part.column("text")), strict=True):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                terms = TERM.findall(text.lower())
                n.update(terms)
                d.update(set(terms))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from rows(held)
                held = {}
        yield from rows(held)

    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def probability(count: Column, total: Column, kept: Column) -> Column:
    """p; in decimals, as 10^9 counts may be beyond a long."""
    wide = lambda c: c.cast("decimal(19,0)")
    scaled = wide(count + 2) * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.call_function("div", scaled, wide(total + 2 * kept)) + 1


def divergence(p: Column, q: Column) -> Column:
    """f; p and q are below 2^30.5, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def f_array(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def tree_rests(lengths: np.ndarray, source: np.ndarray, p: np.ndarray, zero: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, rest) summed over the tree of sorted rows: row k has the next ``lengths[k]`` items (source, p, zero) and stands for ``times[k]`` terms.

    The nodes of depth d are the stretches of rows that begin alike up to their d-th item.
    """
    starts = np.cumsum(lengths) - lengths
    fresh = np.zeros(len(lengths), bool)  # the row's prefix is not that of the row before
    a, b, rests = [], [], []
    for d in range(int(lengths.max(initial=0))):
        rows = np.flatnonzero(lengths > d)
        here = starts[rows] + d
        before = np.append(-1, rows[:-1])
        new = fresh[rows] | (before != rows - 1)  # the row before ended above
        new[1:] |= (source[here[1:]] != source[here[:-1]]) | (p[here[1:]] != p[here[:-1]])
        new[0] = True
        fresh[:] = True
        fresh[rows] = new
        weight = np.add.reduceat(times[rows], np.flatnonzero(new))
        node = starts[rows[new]]
        own = node + d
        for e in range(d):
            up = node + e
            rest = f_array(p[own], p[up]) - f_array(p[own], zero[up]) - f_array(zero[own], p[up]) + f_array(zero[own], zero[up])
            a.append(source[up])
            b.append(source[own])
            rests.append(rest * weight)
        if len(a) > 64:
            a, b, rests = ([x] for x in _summed(a, b, rests))
    return _summed(a, b, rests)


def _summed(a: list, b: list, rests: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, rests = np.concatenate(a), np.concatenate(b), np.concatenate(rests)
    order = np.lexsort((b, a))
    a, b, rests = a[order], b[order], rests[order]
    at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return a[at], b[at], np.add.reduceat(rests, at)


def pair_rests(rows: DataFrame) -> DataFrame:
    """lang, a, b (numbers of sources, a < b), rest, in parts, from ``rows`` (lang, items: array of source, p, zero; times)."""
    workers_see_package(rows.sparkSession)
    out = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("rest", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []

        def trees() -> Iterator[pa.RecordBatch]:
            whole = pa.concat_tables(waiting).combine_chunks()
            lang = whole.column("lang").combine_chunks().dictionary_encode()
            codes = lang.indices.to_numpy(zero_copy_only=False)
            edges = np.append(np.flatnonzero(np.append(True, codes[1:] != codes[:-1])), len(codes))
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                part = whole.slice(s, e - s)
                lists = part.column("items").combine_chunks()
                lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
                item = lists.flatten()
                numbers = [item.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
                lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                a, b, rest = tree_rests(lengths, *numbers, part.column("times").to_numpy().astype(np.int64))
                yield record_batch(out, [lang.dictionary[int(codes[s])].as_py()] * len(a), a, b, rest)

        size = nodes = 0
        for batch in batches:
            waiting.append(pa.Table.from_batches([batch]))
            size, nodes = size + batch.num_rows, nodes + len(batch.column(1).flatten())
            if size >= TREE or nodes >= NODES:
                yield from trees()
                waiting, size, nodes = [], 0, 0
        if waiting:
            yield from trees()

    return rows.select("lang", "items", "times").mapInArrow(run, "lang string, a long, b long, rest long")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each group all other sources of its language (pair) and its ``top`` most overused terms (term), largest value first."""
    counts = stored(counted(docs), "terms")
    term = ["lang", "term"]
    # one exchange serves both sums
    by_source = counts.where("term is not null").repartition(*term).groupBy(*term, "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    uses = by_source.groupBy(*term).agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("uses"))  # a row for each source of the language at most
    kept = stored(uses.where(F.col("docs") >= least).drop("docs"), "kept-terms")

    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_total"))
    sums = kept.select("lang", F.explode("uses").alias("u")).groupBy("lang", F.col("u.source").alias("source")).agg(F.sum("u.n").alias("source_total"))
    groups = counts.where("term is null").select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("source_total", "lang_total", "v")))
    numbered = groups.withColumn("number", F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long"))
    zero = F.when(F.col("v") > 0, probability(F.lit(0).cast("long"), F.col("source_total"), F.col("v")))
    groups = stored(numbered.withColumn("zero", zero), "groups")

    spread = kept.select("lang", "term", "total", F.explode("uses").alias("u")).select("lang", "term", "total", "u.source", "u.n").join(groups, ["lang", "source"])
    at = spread.select("lang", "source", "term", "number", "zero", probability(F.col("n"), F.col("source_total"), F.col("v")).alias("p"), probability(F.col("total"), F.col("lang_total"), F.col("v")).alias("q"))
    at = stored(at, "term-probabilities")

    over = at.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = over.withColumn("rank", rank).where(F.col("rank") <= top)

    items = F.sort_array(F.collect_list(F.struct("number", "p", "zero"))).alias("items")
    rows = at.groupBy(*term).agg(items).groupBy("lang", "items").agg(F.count("*").alias("times")).where("size(items) > 1")
    rests = pair_rests(rows.repartitionByRange("lang", "items").sortWithinPartitions("lang", "items")).groupBy("lang", "a", "b").agg(F.sum("rest").alias("rest"))

    other = groups.select("lang", F.col("number").alias("other"), F.col("source").alias("item"), F.col("zero").alias("other_zero"))
    single = at.groupBy("lang", "number", "p", "zero").agg(F.count("*").alias("times")).join(other, "lang").where("number <> other")
    gain = F.col("times") * (divergence(F.col("p"), F.col("other_zero")) - divergence(F.col("zero"), F.col("other_zero")))
    singles = single.select("lang", "number", "other", gain.alias("gain"))
    due = singles.union(singles.select("lang", "other", "number", "gain"))
    due = due.union(rests.select("lang", "a", "b", "rest")).union(rests.select("lang", "b", "a", "rest"))
    due = due.groupBy("lang", "number", "other").agg(F.sum("gain").alias("due"))

    base = F.when(F.col("v") > 0, F.col("v") * divergence(F.col("zero"), F.col("other_zero"))).otherwise(0)
    both = groups.join(other, "lang").where("number <> other").join(due, ["lang", "number", "other"], "left")
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", (base + F.coalesce("due", F.lit(0))).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return pairs.union(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_P = "CAST(1 + (1000000000::HUGEINT * ({} + 2)) // ({} + 2 * v) AS BIGINT)"
OP13_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
t AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= {LEAST}),
l AS (SELECT lang, count(*) AS v, sum(total) AS lang_total FROM t GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN t USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS source_total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
a AS (SELECT lang, source, term, coalesce(n, 0) AS n, {_P.format("coalesce(n, 0)", "source_total")} AS p, {_P.format("total", "lang_total")} AS q
  FROM g JOIN t USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS BIGINT) AS value FROM a x JOIN a y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  UNION ALL SELECT x.lang, x.source, 'pair', y.source, 0 FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source WHERE x.lang NOT IN (SELECT lang FROM l)
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM a WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM f QUALIFY part = 'pair' OR rank <= {TOP}"""
