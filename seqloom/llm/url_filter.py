"""URL filters as a sort-merge range join of reversed hosts with rule intervals.

A key is the host with its labels reversed, each followed by a dot, then the path: ``blog.example.com/en/1`` gives
``com.example.blog./en/1``. A label holds no dot and a path begins with a slash, so a key begins with a rule's ``com.example.``
just if its host is that host or a subdomain, whatever other characters the host holds. All keys with one beginning stand together
in order, so rules are intervals that nest or are disjoint. Split places from a sample of the urls (drawn by hash at a rate that
gives about ``SAMPLE`` places; they only balance the work) cut the line of keys into ranges. A place is a key and a hash of the
page id, so a host is cut inside by path, and one url that stands for any share of the rows by the rows' hashes. A rule is copied
to every range that its interval meets. Each range is sorted and swept once: a stack holds the rules whose interval is open, and a
url is judged by the longest of them whose path its own path starts with.

A null url, or one without ``://``, has empty host and path. No rule: ``DEFAULT``. Several equal rules: the smallest verdict.
Null page ids and repeated rows are kept; a repeated row is judged each time. Other columns are ignored. Empty tables give empty
results; rules never drop or repeat rows of the urls.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import record_batch, table, workers_see_package

DEFAULT = "allow"
#: Places in the sample that sets the splits (on average), rows that a range should hold.
SAMPLE, RANGE_ROWS = 20_000, 100_000
#: Host, path, verdict of the rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "."), F.lit(".")))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, key, kind, id, host, path, verdict) in order; kind 0 opens a rule, 1 is a url."""
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
    stack: list[tuple[str, str, str, str]] = []
    current = None
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for part, key, kind, page_id, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != current:
                current, stack = part, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, host, path, verdict))
                continue
            fits = [r for r in stack if path.startswith(r[2])]
            best = max(fits, key=lambda r: (len(r[1]) + len(r[2]), -ord(r[3][0])), default=None)
            for c, v in zip(out, (page_id, host, path, best and best[1] + best[2], best[3] if best else DEFAULT), strict=True):
                c.append(v)
        yield record_batch(schema, *out)


def judge(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule (host and path of the longest that fits, else null), verdict for each row of ``urls`` (page_id, url)."""
    spark = urls.sparkSession
    workers_see_package(spark)
    keyed = urls.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = keyed.withColumn("key", F.concat(host_key(F.col("host")), "path")).withColumn("mark", F.xxhash64("page_id"))
    rows = keyed.count()
    ranges = max(1, -(-rows // RANGE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")) if rows > RANGE_ROWS // 10 else 1)
    splits = _splits(keyed, rows, ranges) if ranges > 1 else []
    shipped = spark.sparkContext.broadcast(splits)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shipped.value
        for batch in batches:
            keys, marks, kinds = (batch.column(c).to_pylist() for c in ("key", "mark", "kind"))
            first = [bisect_right(at, (k, m)) for k, m in zip(keys, marks, strict=True)]
            # a rule meets all ranges up to the last split that begins with its key
            last = [f if kind else max(f, bisect_right(at, k, key=lambda s: s[0][: len(k)])) for f, k, kind in zip(first, keys, kinds, strict=True)]  # noqa: B023
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int32()), pa.array(last, pa.int32())], [*batch.schema.names, "lo", "hi"])

    lowest = F.lit(-(1 << 63)).cast("long")
    opened = rules.select(host_key(F.col("host")).alias("key"), lowest.alias("mark"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict")
    asked = keyed.select("key", "mark", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    placed = opened.unionByName(asked).mapInArrow(place, "key string, mark long, kind int, page_id long, host string, path string, verdict string, lo int, hi int")
    spread = placed.withColumn("part", F.explode(F.sequence("lo", "hi"))).select("part", "key", "kind", "page_id", "host", "path", "verdict")
    # a rule's own key sorts before the urls inside it; nested rules come in order of length
    ordered = spread.repartition(ranges, "part").sortWithinPartitions("part", "key", "kind")
    return ordered.mapInArrow(_sweep, "page_id long, host string, path string, rule string, verdict string")


def _splits(keyed: DataFrame, rows: int, ranges: int) -> list[tuple[str, int]]:
    """Places (key, mark) that cut ``keyed`` into about equal ranges, from a sample of about ``SAMPLE`` different places."""
    least = int((1 - 2 * min(1.0, SAMPLE / rows)) * (1 << 63))
    drawn = keyed.where(F.xxhash64("key", "mark") >= F.lit(least)).groupBy("key", "mark").agg(F.count("*").alias("n"))
    sample = sorted(tuple(r) for r in drawn.toLocalIterator())
    total, seen, out = sum(n for _, _, n in sample), 0, []
    for key, mark, n in sample:
        if seen * ranges // total < (seen + n) * ranges // total < ranges:
            out.append((key, mark))
        seen += n
    return out


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules_table(spark))


OP6_SQL = """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, regexp_extract(r, '^[^/?#]*') AS raw, r FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v FROM p JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)
"""
