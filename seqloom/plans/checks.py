"""Quality checks and key resolution on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import checks as op
from seqloom.plans.bind import table
from seqloom.plans.registry import query
from seqloom.sources.files import listed
from seqloom.sources.store import discarded, fresh_path


def _split(col):
    return F.when(col % 5 < 3, "train").when(col % 5 == 3, "val").otherwise("test")


_SPLIT = "CASE WHEN {0} % 5 < 3 THEN 'train' WHEN {0} % 5 = 3 THEN 'val' ELSE 'test' END"


@query("q1_manifest", """SELECT l_orderkey, l_linenumber, n_name, 'clips/' || l_returnflag || '/' || l_orderkey || '-' || l_linenumber || '.mp4' AS video_path, l_orderkey || '-' || l_linenumber AS video_id
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1""")
def manifest(spark, sf_dir):
    wanted = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").where("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    path = F.concat(F.lit("clips/"), "l_returnflag", F.lit("/"), "l_orderkey", F.lit("-"), "l_linenumber", F.lit(".mp4"))
    return op.manifest(table(spark, sf_dir, "lineitem"), wanted, "l_suppkey", path).select("l_orderkey", "l_linenumber", "n_name", "video_path", "video_id")


@query("q2_leaks", f"""SELECT o_custkey, count(DISTINCT s) AS n_splits, string_agg(DISTINCT s, ',' ORDER BY s) AS splits FROM (SELECT o_custkey, {_SPLIT.format('o_orderkey')} AS s FROM orders) GROUP BY 1 HAVING count(DISTINCT s) > 1""")
def leaks(spark, sf_dir):
    return op.leaks(table(spark, sf_dir, "orders").withColumn("split", _split(F.col("o_orderkey"))), "o_custkey", "split")


@query("q3_reconcile", f"""WITH c AS (SELECT {_SPLIT.format('c_custkey')} AS split, count(*) AS n FROM customer GROUP BY 1), e(split, expected) AS (VALUES ('train', 900), ('val', 301), ('dev', 5))
SELECT split, n, expected, n IS NOT DISTINCT FROM expected AS ok FROM c FULL JOIN e USING (split)""")
def reconcile(spark, sf_dir):
    expected = spark.createDataFrame([("train", 900), ("val", 301), ("dev", 5)], "split string, expected long")
    return op.reconcile(table(spark, sf_dir, "customer").withColumn("split", _split(F.col("c_custkey"))), expected, "split")


@query("q4_missing_files", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_files(spark, sf_dir):
    present = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return op.missing(table(spark, sf_dir, "orders").select("o_orderkey"), present, "o_orderkey")


@query("q4_missing_listed", "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 397 = 0 AND source IS NOT NULL)")
def missing_listed(spark, sf_dir):
    """Sources that the documents name but that have no file: documents of some ids are written in a folder for each source, and the folders' files are listed."""
    d, path = table(spark, sf_dir, "documents"), fresh_path(spark, "listed")
    d.where("doc_id % 397 = 0").select("doc_id", "source").write.partitionBy("source").parquet(path)
    name = F.regexp_extract("path", r"/source=([^/]+)/[^/]+$", 1)
    present = listed(spark, discarded(spark, path)).where("length > 0").select(name.alias("source"))
    return op.missing(d.where("source is not null").select("source").distinct(), present, "source")


@query("q5_completeness", """SELECT doc_id, CASE WHEN l IS NULL THEN 'missing' WHEN d IS NULL THEN 'orphan' ELSE 'ok' END AS status
FROM (SELECT DISTINCT doc_id, 1 AS d FROM documents WHERE doc_id % 3 < 2) FULL JOIN (SELECT DISTINCT doc_id, 1 AS l FROM labels) USING (doc_id)""")
def completeness(spark, sf_dir):
    return op.completeness(table(spark, sf_dir, "documents").where("doc_id % 3 < 2"), table(spark, sf_dir, "labels"), "doc_id")


@query("q6_structural_checks", """WITH p AS (SELECT doc_id, concat_ws('; ', CASE WHEN length(text) = 0 THEN 'no text' END, CASE WHEN length(text) <> n_chars THEN 'length differs' END, CASE WHEN length(text) > 5000 THEN 'too long' END,
  CASE WHEN lang NOT IN ('en', 'fr') THEN 'language' END, CASE WHEN contains(text, '###') THEN 'marks' END) AS problems FROM documents) SELECT doc_id, problems FROM p WHERE problems <> ''""")
def structural_checks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rules = {"no text": F.length("text") == 0, "length differs": F.length("text") != F.col("n_chars"), "too long": F.length("text") > 5000, "language": ~F.col("lang").isin("en", "fr"), "marks": F.contains("text", F.lit("###"))}
    return op.problems(d, ["doc_id"], rules)


#: What is done to the clip of each number modulo 9, and what is found.
_PLANTED = ("missing arrays", "points without two coordinates", "no frames", "keypoints and scores differ in frames", "wrong number of points", "keypoints not finite", "scores not finite", "extra of the wrong shape; tag of another backend", "")
_FOUND = " ".join(f"WHEN {k} THEN '{text}'" for k, text in enumerate(_PLANTED))


@query("q6_clip_checks", f"SELECT DISTINCT vec_id // 10 AS clip, CASE vec_id // 10 % 9 {_FOUND} END AS problems FROM embeddings")
def clip_checks(spark, sf_dir):
    """Ten embeddings are a clip of 32 points; a fault is planted in each of eight clips out of nine."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    f = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 10").alias("clip"), (F.col("vec_id") % 10).alias("t"), e.alias("e"))
    f = f.select("clip", F.struct("t", F.expr("transform(sequence(0, 31), i -> array(e[2 * i], e[2 * i + 1]))").alias("k"), F.expr("transform(sequence(0, 31), i -> abs(e[i]))").alias("s"), F.slice("e", 1, 52).alias("x")).alias("f"))
    g = f.groupBy("clip").agg(F.array_sort(F.collect_list("f")).alias("f")).select("clip", (F.col("clip") % 9).alias("m"), F.col("f.k").alias("k"), F.col("f.s").alias("s"), F.col("f.x").alias("x"))
    first = lambda new, column: F.expr(f"concat(array({new}), slice({column}, 2, 100))")
    m = F.col("m")
    k = F.when(m == 1, first("concat(array(array(1D, 2D, 3D)), slice(k[0], 2, 100))", "k")).when(m == 2, F.expr("slice(k, 1, 0)")).when(m == 4, first("slice(k[0], 2, 100)", "k"))
    k = k.when(m == 5, first("concat(array(array(double('nan'), 0D)), slice(k[0], 2, 100))", "k")).when(m != 0, F.col("k"))
    s = F.when(m == 2, F.expr("slice(s, 1, 0)")).when(m == 3, F.expr("slice(s, 2, 100)")).when(m == 6, first("concat(array(double('-inf')), slice(s[0], 2, 100))", "s")).otherwise(F.col("s"))
    x = F.when(m == 2, F.expr("slice(x, 1, 0)")).when(m == 7, first("slice(x[0], 1, 51)", "x")).otherwise(F.col("x"))
    clips = g.select("clip", F.lit("full").alias("backend"), F.when(m == 7, "small").when(m == 8, "full").alias("tag"), k.alias("keypoints"), s.alias("scores"), x.alias("extra"))
    return op.clip_problems(clips, {"full": 32, "small": 17}, {"full": 52})


_DRIFT = """e AS (SELECT source, mode(lang) AS lang, CASE WHEN max(n_chars) > 20000 THEN 'long' ELSE 'short' END AS kind FROM documents WHERE lang = 'en' AND source <> 'src3' GROUP BY source),
r AS (SELECT doc_id, d.source, d.lang, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS kind FROM documents d),
j AS (SELECT doc_id, r.source, CASE WHEN e.source IS NULL THEN '' ELSE concat_ws(',', CASE WHEN r.lang IS DISTINCT FROM e.lang THEN 'lang' END, CASE WHEN r.kind IS DISTINCT FROM e.kind THEN 'kind' END) END AS mismatches, e.source IS NULL AS unk FROM r LEFT JOIN e USING (source)),
s AS (SELECT doc_id, source, mismatches, CASE WHEN unk THEN 'unknown' WHEN mismatches <> '' THEN 'stale' ELSE 'ok' END AS status FROM j)"""


def _drift(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    expected = d.where("lang = 'en' and source <> 'src3'").groupBy("source").agg(F.first("lang").alias("lang"), F.when(F.max("n_chars") > 20000, "long").otherwise("short").alias("kind"))
    rows = d.select("doc_id", "source", "lang", F.when(F.col("n_chars") > 2000, "long").otherwise("short").alias("kind"))
    return op.drift(rows, expected, "source", ["lang", "kind"])


@query("q7_drift", f"WITH {_DRIFT} SELECT doc_id, source, mismatches, status FROM s")
def drift(spark, sf_dir):
    return _drift(spark, sf_dir).select("doc_id", "source", "mismatches", "status")


@query("q8_roll_up", f"""WITH {_DRIFT} SELECT source, count(*) FILTER (WHERE status = 'ok') AS healthy, count(*) FILTER (WHERE status = 'stale') AS stale, count(*) FILTER (WHERE status = 'unknown') AS unknown,
 count(*) FILTER (WHERE status <> 'ok') = 0 AS ok FROM s GROUP BY source""")
def roll_up(spark, sf_dir):
    df = _drift(spark, sf_dir).withColumn("status", F.when(F.col("status") == "ok", "healthy").otherwise(F.col("status")))
    return op.roll_up(df, "source", "status", ["healthy", "stale", "unknown"])


@query("q9_attribute_join", """SELECT l_orderkey, l_linenumber, p_brand, p_size, coalesce(CAST(trunc(TRY_CAST(regexp_extract(p_brand, '\\d+$') AS DOUBLE)) AS INT) > 20, false) OR lower(p_type) = 'promo' AS multi,
'p_color' AS absent FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def attribute_join(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    joined, absent, _ = op.attribute_join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), part, "l_partkey", ["p_brand", "p_size", "p_type", "p_color"])
    count = F.regexp_extract("p_brand", r"\d+$", 0).try_cast("double") - 19
    multi = op.multi_part(count, F.when(F.lower("p_type") == "promo", "yes").otherwise("no"))
    return joined.select("l_orderkey", "l_linenumber", "p_brand", "p_size", multi.alias("multi"), F.lit(",".join(absent)).alias("absent"))


@query("q10_resolve", """WITH e AS (SELECT p_name AS entry, count(DISTINCT p_size % 40) AS n, min(p_size % 40) AS code FROM part WHERE p_brand = 'Brand#1' GROUP BY 1), pr AS (SELECT DISTINCT p_size % 40 AS code FROM part WHERE p_type <> 'PROMO' AND p_size < 35),
u AS (SELECT p_size % 40 AS code, p_type AS name, count(*) AS k FROM part GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_size % 40 ORDER BY count(*) DESC, p_type) = 1),
j AS (SELECT entry, e.code, name, CASE WHEN n > 1 THEN 'several codes' WHEN pr.code IS NULL THEN 'code not present' END AS error FROM e LEFT JOIN pr USING (code) LEFT JOIN u USING (code))
SELECT entry, CASE WHEN error IS NULL THEN code END AS code, CASE WHEN error IS NULL THEN name END AS name, error FROM j""")
def resolve(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("code", F.col("p_size") % 40)
    entries = p.where("p_brand = 'Brand#1'").select(F.col("p_name").alias("entry"), "code")
    return op.resolve(entries, p.where("p_type <> 'PROMO' and p_size < 35"), p.select("code", F.col("p_type").alias("name")))


_NAMES = """nm AS (SELECT upper(p_type) || CASE WHEN p_size % 7 = 0 THEN '' ELSE CAST(p_size % 7 AS VARCHAR) END AS name, avg(CASE WHEN p_size % 7 <> 3 THEN p_retailprice END) AS frequency,
 CASE WHEN p_size % 7 < 6 THEN avg(CASE WHEN p_size > 35 AND p_brand LIKE '%1' THEN 1.0 ELSE 0.0 END) END AS unknown FROM part GROUP BY p_type, p_size % 7)"""


@query("q11_resolve_variants", f"""WITH {_NAMES}, b AS (SELECT DISTINCT upper(p_type) AS base FROM part UNION SELECT 'NOTHING'),
c AS (SELECT b.base, name, frequency, coalesce(unknown <= 0.04, false) AS ok FROM b LEFT JOIN nm ON regexp_replace(name, '\\d*$', '') = b.base),
g AS (SELECT base, count(name) AS n_candidates, coalesce(string_agg(name, ',' ORDER BY frequency IS NULL, frequency DESC, name), '') AS candidates, (array_agg(name ORDER BY frequency IS NULL, frequency DESC, name) FILTER (WHERE ok))[1] AS name FROM c GROUP BY base)
SELECT base, name, n_candidates, candidates, CASE WHEN n_candidates = 0 THEN 'no variant' WHEN name IS NULL THEN 'none eligible' END AS error FROM g""")
def resolve_variants(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("k", F.col("p_size") % 7)
    names = p.groupBy("p_type", "k").agg(F.avg(F.when(F.col("k") != 3, F.col("p_retailprice"))).alias("frequency"), F.avg(F.when((F.col("p_size") > 35) & F.col("p_brand").endswith("1"), 1.0).otherwise(0.0)).alias("u"))
    names = names.select(F.concat(F.upper("p_type"), F.when(F.col("k") == 0, "").otherwise(F.col("k").cast("string"))).alias("name"), "frequency", F.when(F.col("k") < 6, F.col("u")).alias("unknown"))
    bases = p.select(F.upper("p_type").alias("base")).distinct().union(spark.createDataFrame([("NOTHING",)], "base string"))
    return op.resolve_variants(bases, names, 0.04)


@query("q12_confirmed", "WITH r AS (SELECT c_custkey, nullif(c_nationkey, 7) AS code FROM customer) SELECT count(*) AS n, count(code) AS resolved, count(DISTINCT code) AS distinct_codes, count(*) = count(code) AND count(*) = count(DISTINCT code) AS confirmed FROM r")
def confirmed(spark, sf_dir):
    return op.confirmed(table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(7)).alias("code")))


@query("q13_vocabulary_rules", """SELECT 'duplicate name' AS rule, p_name || ' ' || p_brand AS detail FROM part GROUP BY p_name, p_brand HAVING count(*) > 3
UNION ALL SELECT 'price not a whole number', CAST(p_partkey AS VARCHAR) FROM part WHERE p_retailprice % 1 > 0.85 UNION ALL SELECT 'never ordered', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT 'count', CAST(count(*) AS VARCHAR) FROM part HAVING count(*) <> 60""")
def vocabulary_rules(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    ordered = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return op.violations({
        "duplicate name": p.groupBy(F.concat("p_name", F.lit(" "), "p_brand").alias("d")).agg(F.count("*").alias("n")).where("n > 3"),
        "price not a whole number": p.where(F.col("p_retailprice") % 1 > 0.85).select("p_partkey"),
        "never ordered": op.missing(p, ordered, "p_partkey").select("p_partkey"),
        "count": p.agg(F.count("*").alias("n")).where("n <> 60"),
    })


@query("q14_stale_aggregates", """WITH s AS (SELECT o_orderpriority, count(*) AS stored FROM orders WHERE o_orderkey % 1000 <> 1 OR o_orderpriority = '1-URGENT' GROUP BY 1), a AS (SELECT o_orderpriority, count(*) AS actual FROM orders GROUP BY 1)
SELECT o_orderpriority, stored, actual FROM s FULL JOIN a USING (o_orderpriority) WHERE stored IS DISTINCT FROM actual""")
def stale_aggregates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    stored = o.where("o_orderkey % 1000 <> 1 or o_orderpriority = '1-URGENT'").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return op.stale_aggregates(stored, o, "o_orderpriority")


@query("q15_minimal_on_field", """WITH p AS (SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size // 5 AS INT) AS size FROM part)
SELECT x.p_partkey AS a, y.p_partkey AS b, f AS field FROM p x JOIN p y ON x.p_partkey < y.p_partkey, (VALUES ('p_name'), ('p_brand'), ('p_type'), ('size')) AS v(f)
WHERE CASE f WHEN 'p_name' THEN x.p_name <> y.p_name AND x.p_brand = y.p_brand AND x.p_type = y.p_type AND x.size = y.size WHEN 'p_brand' THEN x.p_brand <> y.p_brand AND x.p_name = y.p_name AND x.p_type = y.p_type
 WHEN 'p_type' THEN x.p_type <> y.p_type AND x.p_name = y.p_name AND x.p_brand = y.p_brand AND x.size = y.size ELSE x.size <> y.size AND x.p_name = y.p_name AND x.p_brand = y.p_brand AND x.p_type = y.p_type END""")
def minimal_on_field(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.expr("cast(p_size div 5 as int)").alias("size"))
    return op.minimal_pairs(p, "p_partkey", ["p_name", "p_brand", "p_type", "size"], {"p_brand": "size"})


_LOWER = "list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x))"


@query("q16_unknown_tokens", f"""WITH k AS (SELECT DISTINCT unnest({_LOWER}) AS token FROM documents WHERE lang = 'en') SELECT token, count(*) AS n FROM (SELECT unnest({_LOWER}) AS token FROM conversations) WHERE token NOT IN (SELECT token FROM k) GROUP BY token""")
def unknown_tokens(spark, sf_dir):
    known = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("token")).distinct()
    return op.unknown_tokens(table(spark, sf_dir, "conversations"), F.lower("text"), "[a-z]+", known, "token")


@query("q17_ambiguous_lexicon", "SELECT p_name, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS targets FROM part WHERE p_size < 10 GROUP BY p_name HAVING count(DISTINCT p_type) > 1")
def ambiguous(spark, sf_dir):
    return op.ambiguous(table(spark, sf_dir, "part").where("p_size < 10"), "p_name", "p_type")


@query("q18_role_sets", "SELECT DISTINCT p_brand FROM part WHERE p_size > 40 EXCEPT SELECT p_brand FROM part WHERE p_size < 5 AND p_type <> 'LARGE'")
def role_sets(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return op.outside(p.where("p_size > 40").select("p_brand"), p.where("p_size < 5 and p_type <> 'LARGE'"))


@query("q19_class_drift", """WITH s AS (SELECT DISTINCT p_brand AS stored FROM part), c AS (SELECT DISTINCT CASE WHEN p_brand LIKE 'Brand#3%' THEN replace(p_brand, 'Brand', 'Mark') ELSE p_brand END AS current FROM part),
a AS (SELECT stored, row_number() OVER (ORDER BY stored) AS position FROM s), b AS (SELECT current, row_number() OVER (ORDER BY current) AS position FROM c)
SELECT position, stored, current FROM a FULL JOIN b USING (position) WHERE stored IS DISTINCT FROM current""")
def class_drift(spark, sf_dir):
    """The brands of all parts against a version in which some were renamed."""
    p = table(spark, sf_dir, "part").select("p_brand")
    renamed = F.when(F.col("p_brand").like("Brand#3%"), F.replace("p_brand", F.lit("Brand"), F.lit("Mark"))).otherwise(F.col("p_brand"))
    return op.class_drift(p, p.select(renamed.alias("p_brand")), "p_brand")


@query("q20_partition_faults", """WITH r AS (SELECT l_partkey AS idx FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1 UNION ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2),
g AS (SELECT idx, count(*) AS n FROM r GROUP BY idx) SELECT p_partkey AS idx, coalesce(n, 0) AS n FROM part LEFT JOIN g ON p_partkey = idx WHERE coalesce(n, 0) <> 1""")
def partition_faults(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    regions = li.where("(l_returnflag = 'A' and l_linenumber = 1) or (l_returnflag = 'R' and l_linenumber = 2)").select(F.col("l_partkey").alias("idx"))
    return op.partition_faults(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx")), regions)
