"""Embeddings, labels and verdicts on embeddings and parts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seqloom.operators import heads as fitted
from seqloom.operators import verdict as op
from seqloom.plans.bind import table
from seqloom.plans.evaluate import _DIST, _EMB, distances
from seqloom.plans.geometry import _FEAT, features
from seqloom.plans.registry import query
from seqloom.plans.signal import rounded

_PARAMS = ["p_brand", "p_type", "p_name"]


@query("e1_encode_labels", "SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)")
def encode_labels(spark, sf_dir):
    return op.encode_labels(table(spark, sf_dir, "part"), "p_brand")


_SUPPORT = """l AS (SELECT p_partkey, p_size > 40 AS m, unnest(['p_brand', 'p_type', 'p_name']) AS parameter, unnest([p_brand, p_type, p_name || (p_partkey % 9)]) AS value FROM part),
s AS (SELECT parameter, value, count(DISTINCT p_partkey) AS n FROM l GROUP BY 1, 2)"""


def _attributes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.concat("p_name", F.col("p_partkey") % 9).alias("p_name"), "p_size")


@query("e2_support", f"WITH {_SUPPORT} SELECT parameter, value, n, n >= 3 AS well FROM s")
def support(spark, sf_dir):
    return op.support(_attributes(spark, sf_dir).drop("p_size"), "p_partkey", _PARAMS)


@query("e3_judged", f"WITH {_SUPPORT} SELECT p_partkey, parameter, value, n, NOT m AND n >= 3 AS judged FROM l JOIN s USING (parameter, value)")
def judged(spark, sf_dir):
    return op.judged(_attributes(spark, sf_dir), "p_partkey", _PARAMS, F.col("p_size") > 40)


@query("e4_nearest_by_label", f"WITH {_DIST} SELECT query, label, round(distance, 6) AS distance FROM d")
def nearest_by_label(spark, sf_dir):
    return distances(spark, sf_dir).select("query", "label", F.round("distance", 6).alias("distance"))


@query("e5_self_excluded", f"WITH {_EMB} SELECT q.vec_id AS query, r.label, round(min(list_distance(q.v, r.v)), 6) AS distance FROM e q JOIN e r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id GROUP BY 1, 2")
def self_excluded(spark, sf_dir):
    """The stated query set of searches, ids divisible by 50, against all other vectors."""
    e = table(spark, sf_dir, "embeddings")
    return op.nearest_by_label(e.where("vec_id % 50 = 0"), e, others=True).select("query", "label", F.round("distance", 6).alias("distance"))


_LOGITS = "l AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS g FROM embeddings)"


@query("e6_categorical_verdict", f"""WITH {_LOGITS}, p AS (SELECT vec_id, label, 'c' || (list_position(g, list_max(g)) - 1) AS predicted, 1 / list_sum(list_transform(g, lambda x: exp(x - list_max(g)))) AS confidence FROM l)
SELECT vec_id, predicted, round(confidence, 6) AS confidence, CASE WHEN label % 4 <> 3 THEN predicted = 'c' || label END AS correct FROM p""")
def categorical_verdict(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("g"))
    target = F.concat(F.lit("c"), "label")  # each value is the logit of a class
    return op.categorical_verdict(e, "g", [f"c{k}" for k in range(64)], target, F.col("label") % 4 != 3).select("vec_id", "predicted", F.round("confidence", 6).alias("confidence"), "correct")


@query("e7_binary_verdict", """WITH p AS (SELECT vec_id, label, 1 / (1 + exp(-CAST(embedding[5] AS DOUBLE))) AS p FROM embeddings)
SELECT vec_id, p > 0.5 AS predicted, round(greatest(p, 1 - p), 6) AS confidence, CASE WHEN label <> 4 THEN (p > 0.5) = (label % 2 = 0) END AS correct FROM p""")
def binary_verdict(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[4].alias("g"))
    return op.binary_verdict(e, "g", F.col("label") % 2 == 0, F.col("label") != 4).select("vec_id", "predicted", F.round("confidence", 6).alias("confidence"), "correct")


@query("e8_score_batches", "SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS mean, round(CAST(list_max(embedding) AS DOUBLE), 6) AS top FROM embeddings")
def score_batches(spark, sf_dir):
    s = op.score_batches(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", lambda x: np.stack([x.mean(axis=1), x.max(axis=1)], axis=1))
    return s.select("vec_id", F.round(F.col("scores")[0], 6).alias("mean"), F.round(F.col("scores")[1], 6).alias("top"))


@query("e9_pool", f"WITH {_FEAT} SELECT series, col, round(avg(v), 6) AS mean, round(max(v), 6) AS top FROM long GROUP BY 1, 2")
def pool(spark, sf_dir):
    return rounded(op.pool(features(spark, sf_dir)))


@query("e10_merge_max", "SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(greatest(z[1], z[2]) AS DOUBLE))), 5) AS total FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def merge_max(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    both = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return both.select("vec_id", F.round(F.aggregate(op.merge_max("a", "b"), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("e11_unit", "WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT vec_id, CAST(i AS INT) AS i, round(v[i + 1] / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12), 6) AS x FROM (SELECT *, unnest(range(0, len(v))) AS i FROM s)")
def unit(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(op.unit("embedding")).alias("i", "x"))
    return e.withColumn("x", F.round("x", 6))


@query("e12_hard_examples", f"""WITH {_EMB}, d AS (SELECT a.vec_id, a.label = b.label AS same, greatest(1e-6, list_distance(a.v, b.v)) AS d FROM e a JOIN e b ON a.vec_id // 50 = b.vec_id // 50 AND a.vec_id <> b.vec_id),
g AS (SELECT vec_id, max(d) FILTER (WHERE same) AS p, min(d) FILTER (WHERE NOT same) AS n FROM d GROUP BY 1) SELECT vec_id, round(p, 6) AS positive, round(n, 6) AS negative, round(CASE WHEN p IS NOT NULL AND n IS NOT NULL THEN greatest(0, p - n + 0.2) ELSE 0 END, 6) AS loss FROM g""")
def hard_examples(spark, sf_dir):
    b = table(spark, sf_dir, "embeddings").withColumn("batch", F.expr("vec_id div 50"))
    return rounded(op.hard_examples(b)).drop("batch")


@query("e13_pk_batches")
def pk_batches(spark, sf_dir):
    return op.pk_batches(table(spark, sf_dir, "embeddings"), spark.range(0, 40).withColumnRenamed("id", "batch"), 4, 8, 7)


#: Columns of the hands in the clips, the other columns, and the columns of the pooled features that each head sees.
_LEFT, _RIGHT, _REST = list(range(8)), list(range(8, 16)), list(range(16, 32))
HEADS = {"handshape": list(range(16)), "major_location": list(range(16, 48)), "minor_location": list(range(16, 48)), "movement": list(range(16, 48)), "repeated_movement": list(range(16, 48))}


def clips_of_five(spark, sf_dir):
    """series, t, f: five embeddings in a row make a clip."""
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 5").alias("series"), (F.col("vec_id") % 5).cast("int").alias("t"), F.transform("embedding", lambda x: x.cast("double")).alias("f"))


def pooled_clips(frames):
    return fitted.pooled(frames, "f", _LEFT, _RIGHT, _REST)


def profiled(spark, sf_dir):
    """series, feat and what each clip is like: which of a few columns is largest (the tables' own labels can't be told from the embeddings)."""
    largest = lambda c, *at: F.concat(F.lit(c), (F.array_position(x := F.array(*[F.col("feat")[i] for i in at]), F.array_max(x)) - 1).cast("string"))
    kinds = {"handshape": largest("h", 0, 1, 2, 3), "major_location": largest("a", 16, 17, 18), "minor_location": largest("b", 19, 20, 21), "movement": largest("m", 32, 33, 34), "repeated_movement": (F.col("feat")[22] > F.col("feat")[23]).cast("string")}
    return pooled_clips(clips_of_five(spark, sf_dir)).select("series", "feat", *[c.alias(n) for n, c in kinds.items()])


@query("e14_heads")
def heads(spark, sf_dir):
    """Five heads fitted together on four fifths of the clips; on the rest, each one's accuracy and that of the most frequent class."""
    clips = profiled(spark, sf_dir)
    test = clips.where("series % 5 = 4")
    said = fitted.verdicts(test.select("series", "feat"), fitted.fit(clips.where("series % 5 < 4"), HEADS))
    truth = test.unpivot(["series"], list(HEADS), "parameter", "target")
    most = truth.groupBy("parameter", "target").agg(F.count("*").alias("n")).groupBy("parameter").agg((F.max("n") / F.sum("n")).alias("majority"))
    accuracy = said.join(truth, ["series", "parameter"]).groupBy("parameter").agg(F.count("*").alias("clips"), F.avg((F.col("predicted") == F.col("target")).cast("double")).alias("accuracy"))
    return rounded(accuracy.join(most, "parameter"))


@query("e15_majority_profile", """WITH g AS (SELECT p_brand, concat_ws('/', p_type, p_size % 4) AS profile, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, profile, n FROM g QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, profile) = 1""")
def majority_profile(spark, sf_dir):
    return op.majority_profile(table(spark, sf_dir, "part").withColumn("quarter", F.col("p_size") % 4), "p_brand", ["p_type", "quarter"])


@query("e16_readable", """WITH v AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'repeated_movement' ELSE 'handshape' END AS parameter, CASE p_size % 6 WHEN 0 THEN 'True' WHEN 3 THEN 'False' WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN 'HeadAway' WHEN 4 THEN 'a_' || lower(p_type) ELSE 'flatSpread_5' END AS value FROM part),
s AS (SELECT *, list_filter(string_split(regexp_replace(replace(value, '_', ' '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), ' '), lambda w: w <> '') AS w FROM v)
SELECT p_partkey, CASE WHEN parameter = 'repeated_movement' THEN CASE value WHEN 'True' THEN 'repeats' WHEN 'False' THEN 'does not repeat' ELSE value END
 ELSE array_to_string(list_transform(w, lambda x: CASE WHEN length(x) <= 2 THEN upper(x) ELSE upper(x[1]) || lower(x[2:]) END), ' ') END AS said FROM s""")
def readable(spark, sf_dir):
    k = F.col("p_size") % 6
    value = F.when(k == 0, "True").when(k == 3, "False").when(k == 1, F.replace("p_name", F.lit(" "), F.lit("_"))).when(k == 2, "HeadAway").when(k == 4, F.concat(F.lit("a_"), F.lower("p_type"))).otherwise("flatSpread_5")
    return table(spark, sf_dir, "part").select("p_partkey", op.readable(F.when(F.col("p_size") % 3 == 0, "repeated_movement").otherwise("handshape"), value).alias("said"))


def _verdicts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.posexplode(F.array(*[F.lit(p) for p in op.PARAMETERS])).alias("o", "parameter"))
    correct = F.when(((F.col("o_custkey") + F.col("o")) % 4 != 0) & (F.col("o_custkey") % 9 != 0), (F.col("o_orderkey") + 2 * F.col("o")) % 3 != 0)
    return o.select(F.col("o_orderkey").alias("attempt"), "parameter", F.when(F.col("o") == 4, "True").otherwise("closed_b").alias("predicted"), F.when(F.col("o") == 4, "False").otherwise("HeadAway").alias("target"), correct.alias("correct"), (F.col("cents") * (F.col("o") + 1) % 7 / 10).alias("confidence"))


_VERDICTS = """v AS (SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, unnest(['handshape', 'major_location', 'minor_location', 'movement', 'repeated_movement']) AS parameter, unnest(range(0, 5)) AS o FROM orders),
w AS (SELECT o_orderkey AS attempt, parameter, o, CASE WHEN (o_custkey + o) % 4 <> 0 AND o_custkey % 9 <> 0 THEN (o_orderkey + 2 * o) % 3 <> 0 END AS correct, (cents * (o + 1)) % 7 / 10 AS confidence FROM v)"""


@query("e17_focus", f"""WITH {_VERDICTS} SELECT attempt, count(correct) AS judged, count(*) FILTER (WHERE NOT correct) AS wrong, (array_agg(parameter ORDER BY confidence DESC, o) FILTER (WHERE NOT correct))[1] AS focus FROM w GROUP BY 1""")
def focus(spark, sf_dir):
    return op.focus(_verdicts(spark, sf_dir)).select("attempt", "judged", "wrong", "focus")


_NAMES = {"handshape": "hand shape", "major_location": "area", "minor_location": "exact place", "movement": "path", "repeated_movement": "repetition"}
_TIPS = {"handshape": "Look at the fingers", "major_location": "Look at the area", "minor_location": "Nearly there", "movement": "Look at the direction", "repeated_movement": "Count the repeats"}


def _case(m):
    return "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"


@query("e18_coach", f"""WITH {_VERDICTS}, g AS (SELECT attempt, count(correct) AS judged, array_agg(parameter ORDER BY confidence DESC, o) FILTER (WHERE NOT correct) AS f, array_agg({_case(_NAMES).format('parameter')} ORDER BY o) FILTER (WHERE NOT correct) AS names FROM w GROUP BY 1),
h AS (SELECT attempt, judged, f[1] AS p, list_filter(names, lambda x: x <> {_case(_NAMES).format('f[1]')}) AS rest FROM g)
SELECT attempt, CASE WHEN judged = 0 THEN 'Nothing was judged part by part.' WHEN p IS NULL THEN 'Everything judged matched.' ELSE 'Work on ' || {_case(_NAMES).format('p')} || ': seen ' || CASE WHEN p = 'repeated_movement' THEN 'repeats, wanted does not repeat' ELSE 'Closed B, wanted Head Away' END
 || '. ' || {_case(_TIPS).format('p')} || '.' || CASE WHEN len(rest) > 0 THEN ' Not yet right: ' || array_to_string(rest, ', ') || '.' ELSE '' END END AS message FROM h""")
def coach(spark, sf_dir):
    return op.coach(_verdicts(spark, sf_dir), _NAMES, _TIPS)


@query("e19_facts", f"""WITH {_VERDICTS} SELECT attempt, coalesce(string_agg(parameter, ',' ORDER BY parameter) FILTER (WHERE NOT correct), '') AS wrong, coalesce(string_agg(parameter, ',' ORDER BY parameter) FILTER (WHERE correct), '') AS "right",
 count(correct) > 0 AND count(*) FILTER (WHERE NOT correct) = 0 AS all_correct FROM w GROUP BY 1""")
def facts(spark, sf_dir):
    return op.facts(_verdicts(spark, sf_dir))


@query("e20_describe", """WITH p AS (SELECT p_partkey, CASE WHEN p_brand < 'Brand#2' THEN 'open_' || lower(p_type) ELSE 'closed_b' END AS shape, CASE WHEN p_size % 3 = 0 THEN 'Neutral' ELSE 'HeadAway' END AS place, CASE WHEN p_size % 4 = 0 THEN 'None' ELSE 'BackAndForth' END AS motion, p_size % 2 = 0 AS rep, p_size > 40 AS multi, p_type FROM part)
SELECT p_partkey, (CASE WHEN multi THEN 'The first part has ' ELSE 'It has ' END) || (CASE WHEN shape LIKE 'open%' THEN 'an Open ' || upper(p_type[1]) || lower(p_type[2:]) ELSE 'a Closed B' END) || ' shape ' || (CASE WHEN place = 'Neutral' THEN 'in front of the body' ELSE 'at the head away' END) || '. '
 || CASE WHEN motion = 'None' THEN CASE WHEN rep THEN 'It stays in place with a small repeated motion.' ELSE 'It stays in place.' END ELSE 'It makes a ' || CASE WHEN rep THEN 'repeated ' ELSE 'single ' END || 'back and forth movement.' END AS description FROM p""")
def describe(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_brand") < "Brand#2", F.concat(F.lit("open_"), F.lower("p_type"))).otherwise("closed_b").alias("shape"), F.when(F.col("p_size") % 3 == 0, "Neutral").otherwise("HeadAway").alias("place"), F.when(F.col("p_size") % 4 == 0, "None").otherwise("BackAndForth").alias("motion"), "p_size")
    return op.describe(p, "p_partkey", "shape", "place", "motion", F.col("p_size") % 2 == 0, F.col("p_size") > 40)
