"""Learner model: each event is an attempt of its user at its event type; parameters are thirds of the value."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import checks
from seqloom.operators import learner as op
from seqloom.plans.bind import ATTEMPTS, attempts, table
from seqloom.plans.registry import query


def _attempts(spark, sf_dir):
    return attempts(spark, sf_dir).withColumn("parameter", F.concat(F.lit("p"), F.col("event_id") % 3))


def _items(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kinds = e.select(F.col("event_type").alias("item")).distinct().union(spark.createDataFrame([("unseen",)], "item string"))
    return e.select(F.col("user_id").alias("learner")).distinct().join(kinds, how="cross")


_A = f"{ATTEMPTS}, a AS (SELECT *, 'p' || (event_id % 3) AS parameter FROM attempts)"
_EMA = "list_reduce(array_agg(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0.0 END ORDER BY ord) FILTER (WHERE correct IS NOT NULL), lambda m, x: m + 0.3 * (x - m), 0.5::DOUBLE)"
_M = f"m AS (SELECT learner, item, parameter, {_EMA} AS mastery, count(correct) AS attempts FROM a GROUP BY 1, 2, 3 HAVING count(correct) > 0)"
_ITEMS = "items AS (SELECT learner, item FROM (SELECT DISTINCT user_id AS learner FROM events), (SELECT DISTINCT event_type AS item FROM events UNION SELECT 'unseen'))"
_IM = f"{_ITEMS}, im AS (SELECT i.learner, i.item, coalesce(list_reduce(array_agg(mastery ORDER BY parameter) FILTER (WHERE mastery IS NOT NULL), lambda a, x: a + x, 0.0::DOUBLE) / count(mastery), 0.5) AS mastery, CAST(coalesce(sum(attempts), 0) AS BIGINT) AS attempts FROM items i LEFT JOIN m USING (learner, item) GROUP BY 1, 2)"
_PASS = "g AS (SELECT learner, item, ord, coalesce(bool_and(correct), true) AS good FROM a GROUP BY 1, 2, 3)"
_SM2 = """sm AS (SELECT learner, item, list_reduce(list_transform(array_agg(good ORDER BY ord), lambda x: {'reps': CASE WHEN x THEN 1 ELSE 0 END, 'interval': 0, 'ease': 0.0::DOUBLE}), lambda s, x: CASE WHEN x.reps = 1 THEN
 {'reps': s.reps + 1, 'interval': CASE s.reps WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE least(40, CAST(round_even(s.interval * s.ease, 0) AS INT)) END, 'ease': least(3.0::DOUBLE, s.ease + 0.05::DOUBLE)}
 ELSE {'reps': 0, 'interval': 1, 'ease': greatest(1.3::DOUBLE, s.ease - 0.2::DOUBLE)} END, {'reps': 0, 'interval': 1, 'ease': 2.5::DOUBLE}) AS s FROM g GROUP BY 1, 2)"""
_DUE = """tk AS (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY ord, item) AS tick FROM g), ck AS (SELECT learner, max(tick) AS clock FROM tk GROUP BY 1), ls AS (SELECT learner, item, max(tick) AS last_seen FROM tk GROUP BY 1, 2),
du AS (SELECT learner, item, coalesce(clock, 0) AS clock, last_seen, last_seen + s.interval AS due_at, last_seen IS NULL OR clock >= last_seen + s.interval AS is_due FROM items LEFT JOIN ck USING (learner) LEFT JOIN ls USING (learner, item) LEFT JOIN sm USING (learner, item))"""


@query("m1_mastery", f"WITH {_A}, {_M} SELECT learner, item, parameter, round(mastery, 12) AS mastery, attempts FROM m")
def mastery(spark, sf_dir):
    return op.mastery(_attempts(spark, sf_dir), ["learner", "item", "parameter"]).withColumn("mastery", F.round("mastery", 12))


@query("m2_attempts", f"WITH {_A} SELECT learner, item, count(correct) AS attempts FROM a GROUP BY 1, 2")
def attempt_counts(spark, sf_dir):
    return _attempts(spark, sf_dir).groupBy("learner", "item").agg(F.count("correct").alias("attempts"))


@query("m3_item_mastery", f"WITH {_A}, {_M}, {_IM} SELECT learner, item, round(mastery, 12) AS mastery, attempts FROM im")
def item_mastery(spark, sf_dir):
    return op.item_mastery(op.mastery(_attempts(spark, sf_dir), ["learner", "item", "parameter"]), _items(spark, sf_dir)).withColumn("mastery", F.round("mastery", 12))


@query("m4_spacing", f"WITH {_A}, {_PASS}, {_SM2} SELECT learner, item, s.reps AS repetitions, s.interval AS interval, s.ease AS ease FROM sm")
def spacing(spark, sf_dir):
    return op.spacing(op.passes(_attempts(spark, sf_dir)))


@query("m5_passes", "SELECT l_orderkey AS learner, l_linenumber % 3 AS item, l_suppkey % 4 AS ord, coalesce(bool_and(CASE WHEN l_returnflag <> 'A' THEN l_quantity > 20 END), true) AS good FROM lineitem GROUP BY 1, 2, 3")
def passes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("learner"), (F.col("l_linenumber") % 3).alias("item"), (F.col("l_suppkey") % 4).alias("ord"), F.when(F.col("l_returnflag") != "A", F.col("l_quantity") > 20).alias("correct"))
    return op.passes(li)


@query("m6_due", f"WITH {_A}, {_PASS}, {_SM2}, {_ITEMS}, {_DUE} SELECT learner, item, clock, last_seen, due_at, is_due FROM du")
def due(spark, sf_dir):
    passed = op.passes(_attempts(spark, sf_dir))
    return op.due(passed, op.spacing(passed), _items(spark, sf_dir))


_PARTS = "p AS (SELECT p_partkey, p_name, p_brand, p_type, p_size % 5 AS size, p_retailprice > 1000 AS dear FROM part WHERE p_size <= 40)"
_FIELDS = ["p_name", "p_brand", "p_type", "size", "dear"]
_DIFF = " + ".join(f"CAST(x.{f} IS DISTINCT FROM y.{f} AS INT)" for f in _FIELDS)
_MP = f"mp AS (SELECT x.p_partkey AS a, y.p_partkey AS b, CASE {' '.join(f'''WHEN x.{f} IS DISTINCT FROM y.{f} THEN '{f}' ''' for f in _FIELDS)} END AS field FROM p x JOIN p y ON x.p_partkey < y.p_partkey AND {_DIFF} = 1)"


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size <= 40").select("p_partkey", "p_name", "p_brand", "p_type", (F.col("p_size") % 5).alias("size"), (F.col("p_retailprice") > 1000).alias("dear"))


@query("m7_minimal_pairs", f"WITH {_PARTS}, {_MP} SELECT a, b, field FROM mp")
def minimal_pairs(spark, sf_dir):
    return checks.minimal_pairs(_parts(spark, sf_dir), "p_partkey", _FIELDS)


@query("m8_partners", f"WITH {_PARTS}, {_MP}, u AS (SELECT a AS item, field, b AS partner, a, b FROM mp UNION ALL SELECT b, field, a, a, b FROM mp) SELECT item, field, partner FROM u QUALIFY row_number() OVER (PARTITION BY item, field ORDER BY a, b) = 1")
def partners(spark, sf_dir):
    return checks.first_partners(_parts(spark, sf_dir), "p_partkey", _FIELDS)


_DRAW = "(CAST('0x' || substr(md5(concat_ws('|', 3, learner, clock, {0})), 1, 13) AS BIGINT) + 1) / 4503599627370497.0::DOUBLE"
_NEXT = f"""la AS (SELECT learner, item, CASE WHEN NOT correct THEN parameter END AS field FROM a QUALIFY row_number() OVER (PARTITION BY learner ORDER BY ord DESC) = 1),
ct(item, field, partner) AS (VALUES ('click', 'p0', 'view'), ('view', 'p0', 'click'), ('signup', 'p1', 'purchase')), fi AS (SELECT item, arg_min(partner, field) AS partner FROM ct GROUP BY item),
fo AS (SELECT la.learner, min(partner) AS forced FROM la JOIN ct USING (item, field) JOIN items ON items.learner = la.learner AND items.item = partner GROUP BY 1),
lv AS (SELECT learner, item, clock, is_due, mastery, bool_or(is_due) OVER (PARTITION BY learner) AS any_due FROM du JOIN im USING (learner, item)),
be AS (SELECT * FROM lv WHERE is_due OR NOT any_due QUALIFY row_number() OVER (PARTITION BY learner ORDER BY -ln({_DRAW.format('item')}) / greatest(0.05, 1.05 - mastery), item) = 1),
tu AS (SELECT be.*, fi.partner, forced, mastery >= 0.8 AND there.item IS NOT NULL AND {_DRAW.format("'turn'").replace('learner', 'be.learner')} < 0.5 AS turn FROM be LEFT JOIN fi USING (item) LEFT JOIN fo USING (learner) LEFT JOIN items there ON there.learner = be.learner AND there.item = fi.partner)"""


@query("m9_next_item", f"""WITH {_A}, {_M}, {_IM}, {_PASS}, {_SM2}, {_DUE}, {_NEXT} SELECT learner, CASE WHEN forced IS NOT NULL THEN forced WHEN turn THEN partner ELSE item END AS item, CASE WHEN forced IS NOT NULL THEN 'contrast' WHEN turn THEN 'redirect' ELSE 'drawn' END AS reason FROM tu""")
def next_item(spark, sf_dir):
    a, items = _attempts(spark, sf_dir), _items(spark, sf_dir)
    passed = op.passes(a)
    pool = op.due(passed, op.spacing(passed), items).join(op.item_mastery(op.mastery(a, ["learner", "item", "parameter"]), items).select("learner", "item", "mastery"), ["learner", "item"])
    last = a.groupBy("learner").agg(F.max_by(F.struct("item", F.when(~F.col("correct"), F.col("parameter")).alias("field")), "ord").alias("l")).select("learner", "l.item", "l.field")
    contrast = spark.createDataFrame([("click", "p0", "view"), ("view", "p0", "click"), ("signup", "p1", "purchase")], "item string, field string, partner string")
    return op.next_item(pool, last, contrast, 3)


@query("m10_replay", f"WITH {_A}, {_M}, {_IM}, {_PASS}, {_SM2}, {_DUE} SELECT learner, item, round(mastery, 12) AS mastery, attempts, is_due, s.reps AS repetitions, s.interval AS interval, s.ease AS ease FROM im JOIN du USING (learner, item) LEFT JOIN sm USING (learner, item)")
def replay(spark, sf_dir):
    return op.replay(_attempts(spark, sf_dir), _items(spark, sf_dir)).withColumn("mastery", F.round("mastery", 12))


@query("m11_eligible", """SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09) AS eligible,
 CASE WHEN p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) THEN 'not in the bank' WHEN p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09) THEN 'no clip' END AS reason FROM part""")
def eligible(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    return op.eligible(table(spark, sf_dir, "part"), li.where("l_quantity > 45"), li.where("l_discount > 0.09"), "p_partkey")
