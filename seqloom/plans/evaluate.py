"""Evaluation on nearest references among the embeddings, and on verdicts made from the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import evaluate as op
from seqloom.operators import match, verdict
from seqloom.plans.bind import table
from seqloom.plans.registry import query
from seqloom.plans.signal import rounded

_EMB = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_DIST = f"""{_EMB}, d AS (SELECT q.vec_id AS query, q.label AS label_q, r.label, round(min(list_distance(q.v, r.v)), 9) AS distance FROM e q JOIN e r ON q.vec_id % 5 = 4 AND r.vec_id % 5 < 4 GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, label) AS rank FROM d)"""


def distances(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return verdict.nearest_by_label(e.where("vec_id % 5 = 4"), e.where("vec_id % 5 < 4")).withColumn("distance", F.round("distance", 9))


def _ranks(spark, sf_dir):
    return match.ranked(distances(spark, sf_dir))


@query("j1_top_k", f"""WITH {_DIST}, o AS (SELECT query, max(rank) FILTER (WHERE label = label_q) AS rank, count(*) AS labels FROM k GROUP BY query)
SELECT count(*) AS n, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS topk, round(avg(1 / labels), 6) AS chance FROM o""")
def top_k(spark, sf_dir):
    return rounded(op.top_k(_ranks(spark, sf_dir)))


@query("j2_class_accuracy", f"""WITH {_DIST}, g AS (SELECT label_q, label, count(*) AS c FROM k WHERE rank = 1 GROUP BY 1, 2)
SELECT label_q, CAST(sum(c) AS BIGINT) AS n, round(coalesce(sum(c) FILTER (WHERE label = label_q), 0) / sum(c), 6) AS accuracy, (array_agg(label ORDER BY c DESC, label) FILTER (WHERE label <> label_q))[1] AS confused FROM g GROUP BY 1""")
def class_accuracy(spark, sf_dir):
    return rounded(op.class_accuracy(_ranks(spark, sf_dir).where("rank = 1")))


_SEP = f"""{_DIST}, m AS (SELECT query, label_q, distance AS mine FROM d WHERE label = label_q), pr AS (SELECT a, (a + 1) % 10 AS b FROM (SELECT unnest(range(0, 10)) AS a)),
s AS (SELECT a, b, a AS x, b AS y FROM pr UNION ALL SELECT a, b, b, a FROM pr), c AS (SELECT a, b, x, CASE WHEN d.distance < mine THEN 1.0 ELSE 0 END AS c FROM s JOIN m ON label_q = x JOIN d ON d.query = m.query AND d.label = y),
sep AS (SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, avg(c) FILTER (WHERE x = a) AS closer_a, avg(c) FILTER (WHERE x = b) AS closer_b, count(*) AS n, CAST(sum(c) AS BIGINT) AS confused FROM c GROUP BY 1, 2)"""


def _pairs(spark):
    return spark.range(10).select(F.col("id").cast("int").alias("a"), ((F.col("id") + 1) % 10).cast("int").alias("b"))


@query("j3_pair_separation", f"WITH {_SEP} SELECT a, b, round(closer_a, 6) AS closer_a, round(closer_b, 6) AS closer_b, coalesce(closer_a, 0) <= 0.5 AND coalesce(closer_b, 0) <= 0.5 AS separated FROM sep")
def pair_separation(spark, sf_dir):
    return rounded(op.pair_separation(distances(spark, sf_dir), _pairs(spark))).drop("n", "confused")


@query("j4_pair_confusion", f"WITH {_SEP} SELECT a, b, n, confused FROM sep")
def pair_confusion(spark, sf_dir):
    return op.pair_separation(distances(spark, sf_dir), _pairs(spark)).select("a", "b", "n", "confused")


_ROLL = """r AS (SELECT l_returnflag AS source, l_linestatus || (l_linenumber % 3) AS parameter, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS confused, CAST(l_quantity AS BIGINT) AS n FROM lineitem),
p AS (SELECT source, parameter, count(*) AS pairs, CAST(sum(confused) AS BIGINT) AS confused, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2)"""


def _rates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), F.concat("l_linestatus", F.col("l_linenumber") % 3).alias("parameter"), F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("confused"), F.col("l_quantity").cast("long").alias("n"))
    return op.by_parameter(li)


@query("j5_by_parameter", f"WITH {_ROLL} SELECT source, parameter, pairs, confused, n, round(confused / n, 6) AS rate, pairs < 4 AS small_n FROM p")
def by_parameter(spark, sf_dir):
    return rounded(_rates(spark, sf_dir))


@query("j6_agreement", f"WITH {_ROLL}, h AS (SELECT source, arg_max(parameter, confused / n) AS hardest FROM p GROUP BY 1) SELECT source, hardest, (SELECT count(DISTINCT hardest) = 1 FROM h) AS agreed FROM h")
def agreement(spark, sf_dir):
    return op.agreement(_rates(spark, sf_dir))


@query("j7_in_bank", """WITH p AS (SELECT o_custkey AS a, o_orderkey % 1500 AS b FROM orders), k AS (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) SELECT a, b FROM p WHERE a IN (SELECT * FROM k) AND b IN (SELECT * FROM k)""")
def in_bank(spark, sf_dir):
    pairs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 1500).alias("b"))
    return op.in_bank(pairs, table(spark, sf_dir, "customer").where("c_acctbal > 5000"), "c_custkey")


@query("j8_verdict_tally", """WITH v AS (SELECT source AS parameter, CASE WHEN doc_id % 7 <> 0 THEN quality = 1 - toxic END AS correct, n_chars > 1000 AS well FROM documents JOIN labels USING (doc_id))
SELECT parameter, count(*) AS n, count(correct) AS judged, count(*) FILTER (WHERE well) AS well, count(*) FILTER (WHERE correct) AS "right", round(count(*) FILTER (WHERE correct) / count(correct), 6) AS accuracy FROM v GROUP BY 1""")
def verdict_tally(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    v = d.select(F.col("source").alias("parameter"), F.when(F.col("doc_id") % 7 != 0, F.col("quality") == 1 - F.col("toxic")).alias("correct"), "n_chars")
    return rounded(op.verdict_tally(v, F.col("n_chars") > 1000))


@query("j9_boundary_error", """WITH s AS (SELECT CAST(l_quantity AS INT) AS predicted, CAST(l_tax * 400 AS INT) AS t FROM lineitem), e AS (SELECT abs(predicted - t) AS a, CASE WHEN t = 0 THEN 1.0 ELSE abs(predicted - t) / t END AS e FROM s)
SELECT count(*) AS n, round(avg(e), 6) AS mean, round(quantile_cont(e, 0.5), 6) AS median, round(avg(a), 6) AS abs_mean, round(max(e), 6) AS worst, count(*) FILTER (WHERE e > 0.5) AS over FROM e""")
def boundary_error(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("predicted"), F.round(F.col("l_tax") * 400).cast("int").alias("true"))
    return rounded(op.boundary_error(s))


_TWO = """a AS (SELECT l_orderkey * 10 + l_linenumber AS attempt, l_shipdate, l_returnflag AS predicted, l_linestatus AS parameter, CASE WHEN l_tax > 0.02 THEN l_discount > 0.05 END AS correct, l_quantity AS x, l_extendedprice AS y FROM lineitem),
b AS (SELECT attempt, parameter, CASE WHEN attempt % 11 = 0 THEN 'X' ELSE predicted END AS p2, CASE WHEN attempt % 13 <> 0 THEN correct END AS c2, x + attempt % 3 AS x2, y + attempt % 5 AS y2 FROM a)"""


def _two(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("attempt"), F.col("l_returnflag").alias("predicted"), F.col("l_linestatus").alias("parameter"), F.when(F.col("l_tax") > 0.02, F.col("l_discount") > 0.05).alias("correct"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    k = F.col("attempt")
    b = a.withColumns({"predicted": F.when(k % 11 == 0, "X").otherwise(F.col("predicted")), "correct": F.when(k % 13 != 0, F.col("correct")), "x": F.col("x") + k % 3, "y": F.col("y") + k % 5})
    return a, b


@query("j10_verdict_agreement", f"""WITH {_TWO} SELECT parameter, count(*) AS n, round(avg(CASE WHEN correct IS NOT DISTINCT FROM c2 THEN 1.0 ELSE 0 END), 6) AS same_verdict, round(avg(CASE WHEN predicted IS NOT DISTINCT FROM p2 THEN 1.0 ELSE 0 END), 6) AS same_label
FROM a JOIN b USING (attempt, parameter) WHERE correct IS NOT NULL GROUP BY 1""")
def verdict_agreement(spark, sf_dir):
    return rounded(op.verdict_agreement(*_two(spark, sf_dir)))


@query("j11_generalisation_gap", """WITH h AS (SELECT c_nationkey AS run, c_custkey AS epoch, c_acctbal AS val, c_acctbal + c_custkey % 17 AS train FROM customer), l AS (SELECT *, val - lag(val) OVER (PARTITION BY run ORDER BY epoch) AS gain FROM h)
SELECT run, arg_max(epoch, val) AS best_epoch, round(max(val), 6) AS best_val, round(arg_max(train - val, val), 6) AS gap, round(arg_max(gain, epoch), 6) AS last_gain FROM l GROUP BY run""")
def generalisation_gap(spark, sf_dir):
    h = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("run"), F.col("c_custkey").alias("epoch"), F.col("c_acctbal").alias("val"), (F.col("c_acctbal") + F.col("c_custkey") % 17).alias("train"))
    return rounded(op.generalisation_gap(h))


@query("j12_funnel", """WITH r AS (SELECT o_custkey AS sign, o_orderstatus <> 'P' AS s, o_orderpriority <> '5-LOW' AS t, o_totalprice > 250000 AS g, round(o_totalprice / 1000) AS lat FROM orders), m AS (SELECT *, s AND t AND g AS shown FROM r),
p AS (SELECT sign, avg(CASE WHEN shown THEN 1.0 ELSE 0 END) AS p FROM m GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (WHERE s) AS accepted, count(*) FILTER (WHERE s AND t) AS on_target, count(*) FILTER (WHERE shown) AS shown, quantile_cont(lat, 0.5) AS latency_median,
 list_sort(array_agg(lat))[CAST(floor(0.9 * (count(*) - 1)) AS BIGINT) + 1] AS latency_p90, (SELECT round(avg(1 - (1 - p) ** 6), 6) FROM p) AS within, (SELECT count(*) FILTER (WHERE p = 0) FROM p) AS never FROM m""")
def funnel(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sign"), (F.col("o_orderstatus") != "P").alias("in_scope"), (F.col("o_orderpriority") != "5-LOW").alias("has_target"), (F.col("o_totalprice") > 250000).alias("good"), F.round(F.col("o_totalprice") / 1000).alias("latency"))
    return rounded(op.funnel(o))


@query("j13_parity", f"""WITH {_TWO}, j AS (SELECT parameter, predicted IS DISTINCT FROM p2 AS ch, sqrt((x - x2) ** 2 + (y - y2) ** 2) AS gap FROM a JOIN b USING (attempt, parameter))
SELECT parameter, count(*) AS n, count(*) FILTER (WHERE ch) AS changed, round(avg(CASE WHEN ch THEN 0.0 ELSE 1 END), 6) AS match_rate, round(avg(gap), 6) AS mean_gap, round(quantile_cont(gap, 0.95), 6) AS p95_gap FROM j GROUP BY 1""")
def parity(spark, sf_dir):
    return rounded(op.parity(*_two(spark, sf_dir)))
