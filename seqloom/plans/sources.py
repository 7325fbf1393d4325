"""Sources and sinks: tables are written in a foreign form to the shared folder and read back through the importers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators import verdict
from seqloom.plans import rules
from seqloom.plans.bind import FRAMES, POINTS, frames, poses, table
from seqloom.plans.registry import query
from seqloom.plans.signal import rounded
from seqloom.plans.verdict import _SUPPORT, _PARAMS, _attributes
from seqloom.sources import files as op
from seqloom.sources.package import ship
from seqloom.sources.store import discarded, fresh_path


@query("io1_read_csv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, md5(CASE WHEN lang = 'fr' THEN replace(t, 'ou', '\u0153') ELSE t END) AS text_md5 FROM (SELECT *, replace(replace(text, chr(10), ' '), '\"', '') AS t FROM documents)")
def read_csv(spark, sf_dir):
    """Documents by language in three encodings under one folder."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit("")).alias("text"))
    path = fresh_path(spark, "csv")
    foreign = F.translate(F.replace("text", F.lit("ou"), F.lit("\u0153")), op.WINDOWS, op.LATIN_1)  # the bytes of windows-1252
    for name, cond, text, encoding in (("u", "lang in ('en', 'es')", F.col("text"), "utf-8"), ("w", "lang = 'fr'", foreign, "iso-8859-1"), ("l", "lang = 'de'", F.col("text"), "iso-8859-1")):
        d.where(cond).withColumn("text", text).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("encoding", encoding).csv(f"{path}/{name}")
    back = op.read_csv(spark, f"{path}/*/*.csv")
    return back.select("doc_id", "lang", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("io2_aliases", "SELECT l_orderkey AS id, l_linenumber AS line, l_shipdate AS shipped, l_quantity AS amount FROM lineitem")
def aliases(spark, sf_dir):
    return op.select_aliases(table(spark, sf_dir, "lineitem"), {"id": ("L_ORDERKEY",), "line": ("linenumber",), "shipped": ("ship_date", "l_ship"), "amount": ("quant",)})


@query("io3_choose_table", "SELECT 'parts' AS file, true AS complete")
def choose_table(spark, sf_dir):
    path = fresh_path(spark, "headers")
    table(spark, sf_dir, "part").write.option("header", True).csv(f"{path}/parts")
    table(spark, sf_dir, "supplier").write.option("header", True).csv(f"{path}/suppliers")
    chosen = op.choose_table(op.headers(spark, f"{path}/*/*.csv"), ["P_PARTKEY", "p_brand", "p_size"])
    return chosen.select(F.regexp_extract("path", "/([a-z]+)/[^/]*$", 1).alias("file"), "complete")


@query("io4_flatten_units", "SELECT p_brand AS unit, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INT) AS place, p_partkey, p_name FROM part")
def flatten_units(spark, sf_dir):
    path = fresh_path(spark, "units")
    units = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("signs"))
    units.write.json(path)
    return op.flatten_units(spark.read.schema("id string, signs array<struct<p_partkey: bigint, p_name: string>>").json(path))


def _clips(spark, sf_dir):
    p = poses(spark, sf_dir).groupBy("series").agg(F.array_sort(F.collect_list(F.struct("t", "kp", "score"))).alias("x"))
    return p.select("series", F.transform("x", lambda f: f["kp"]).alias("kp"), F.transform("x", lambda f: f["score"]).alias("score"), F.when(F.col("series") % 2 == 0, F.transform("x", lambda f: F.array(f["score"][0]))).alias("extra"))


@query("io5_clip_scan", f"WITH {POINTS} SELECT series, t, round(sum(x), 6) AS x, round(sum(score), 6) AS score, series % 2 = 0 AS extra FROM points GROUP BY 1, 2")
def clip_scan(spark, sf_dir):
    back = op.decode_clips(op.encode_clips(_clips(spark, sf_dir)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return rounded(back.select("series", "t", total(F.transform("kp", lambda p: p["x"])).alias("x"), total("score").alias("score"), F.col("extra").isNotNull().alias("extra")))


@query("io6_index_scan", "SELECT l_orderkey, l_linenumber, p_brand, p_type FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 40) ON l_partkey = p_partkey WHERE l_returnflag = 'A'")
def index_scan(spark, sf_dir):
    manifest = table(spark, sf_dir, "lineitem").withColumn("split", F.col("l_returnflag"))
    part = table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    return op.index_scan(manifest, part, "l_partkey", "A").select("l_orderkey", "l_linenumber", "p_brand", "p_type")


@query("io7_to_do", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) ORDER BY o_orderkey LIMIT 500")
def to_do(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return op.to_do(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey", limit=500)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """attempt, content, meta of series with x, an array of t, energy, p."""
    for batch in batches:
        # an attempt's numbers are read where they lie in the batch; a few attempts are handed on together
        for first in range(0, batch.num_rows, 64):
            part = batch.slice(first, 64)
            content, meta = [], []
            for x in part.column("x"):
                n, (t, energy, p) = len(x), x.values.flatten()
                p = p.to_numpy()
                kp = np.stack([energy.to_numpy(zero_copy_only=False), np.full(n, -1.0)], axis=1)
                content.append(op.pack_attempt(t.to_numpy() / 25, kp, p, p))
                meta.append(json.dumps({"format": op.FORMAT, "n_frames": n, "n_keypoints": 1}))
            names = pa.array([f"u{s}" for s in part.column("series").to_pylist()])
            yield pa.RecordBatch.from_arrays([names, pa.array(content, pa.binary()), pa.array(meta)], ["attempt", "content", "meta"])


def _blobs(spark, sf_dir):
    """Each user's events as one binary attempt of one point a frame."""
    ship(spark)
    g = frames(spark, sf_dir).select("series", "t", "energy", F.col("present").cast("int").alias("p")).groupBy("series").agg(F.array_sort(F.collect_list(F.struct("t", "energy", "p"))).alias("x"))
    return g.mapInArrow(_packed, "attempt string, content binary, meta string")


@query("io8_binary_attempts", f"WITH {FRAMES} SELECT 'u' || series AS attempt, t, round(t / 25, 6) AS time, CAST(present AS INT) AS state, round(CAST(CAST(energy AS FLOAT) AS DOUBLE), 4) AS x FROM frames WHERE series % 10 <> 0")
def binary_attempts(spark, sf_dir):
    done = table(spark, sf_dir, "events").where("user_id % 10 = 0").select(F.concat(F.lit("u"), "user_id").alias("attempt"))
    back = op.decode_attempts(_blobs(spark, sf_dir), done)
    return back.select("attempt", "t", F.round("time", 6).alias("time"), "state", F.round(F.col("kp")[0]["x"].cast("double"), 4).alias("x"))


@query("io9_attempt_log", f"WITH {FRAMES}, n AS (SELECT series, count(*) AS n_frames FROM frames GROUP BY 1) SELECT 'u' || series AS attempt, t, round(energy, 6) AS energy, n_frames FROM frames JOIN n USING (series)")
def attempt_log(spark, sf_dir):
    f = frames(spark, sf_dir).select(F.concat(F.lit("u"), "series").alias("attempt"), "t", "energy", F.to_date("ts").alias("day"))
    meta = f.groupBy("attempt").agg(F.count("*").alias("n_frames"), F.min("day").alias("day"))
    path = fresh_path(spark, "attempts")
    op.write_attempts(f, meta, path)
    back = op.read_attempts(spark, path, "attempt string, t int, energy double, day date", "attempt string, n_frames long, day date")
    return rounded(back.select("attempt", "t", "energy", "n_frames"))


@query("io10_output_manifest", f"WITH {FRAMES} SELECT series, count(*) AS n_frames, round(avg(CASE WHEN present THEN 0.0 ELSE 1.0 END), 4) AS dropout, coalesce(max(CASE WHEN series % 3 = 0 THEN label END), 'unknown') AS backend FROM frames GROUP BY 1")
def output_manifest(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("backend", F.when(F.col("series") % 3 == 0, F.col("label")))
    return op.output_manifest(f, F.col("present"), ["backend"])


@query("io11_learner_state", "SELECT user_id AS learner, event_type AS item, count(*) AS n FROM events GROUP BY 1, 2")
def learner_state(spark, sf_dir):
    """Two snapshots are saved and the newest is loaded; a path without one gives a fresh learner."""
    path, schema = fresh_path(spark, "state"), "learner long, item string, n long"
    fresh = op.load_state(spark, f"{path}/none", schema)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("learner"), F.col("event_type").alias("item"), "event_id")
    count = lambda df: df.groupBy("learner", "item").agg(F.count("*").alias("n"))
    op.save_state(count(e.where("event_id % 2 = 0")), path, 1)
    op.save_state(count(e), path, 2)
    return op.load_state(spark, path, schema).unionByName(fresh)


def _blob(spark, sf_dir):
    """The parts' prices and sizes as a blob by brand."""
    path = fresh_path(spark, "blob")
    p = table(spark, sf_dir, "part").withColumn("v", F.array(F.col("p_retailprice"), F.col("p_size").cast("double")))
    op.write_blob(p, "p_brand", ["p_partkey"], "v", path)
    return discarded(spark, path)


@query("io12_blob_index", "WITH g AS (SELECT p_brand, count(*) AS c FROM part GROUP BY 1) SELECT p_brand, CAST(coalesce(sum(c) OVER (ORDER BY p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, c AS count FROM g")
def blob_index(spark, sf_dir):
    return op.blob_index(spark, _blob(spark, sf_dir)).withColumnRenamed("key", "p_brand")


@query("io12_read_blob", """WITH o AS (SELECT CAST(row_number() OVER (ORDER BY p_brand, p_partkey) - 1 AS BIGINT) AS place, p_brand, CAST(p_retailprice AS FLOAT) AS price, p_size AS size FROM part), m AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT place, round(CAST(price AS DOUBLE), 3) AS price, size FROM o WHERE p_brand IN (SELECT p_brand FROM m)""")
def read_blob(spark, sf_dir):
    """The rows of the largest brand, read back by its offset."""
    path = _blob(spark, sf_dir)
    r = op.blob_index(spark, path).orderBy(F.desc("count"), "key").first()
    return op.read_blob(spark, path, r["start"], r["count"], 2).select(F.col("at").alias("place"), F.round(F.col("v")[0].cast("double"), 3).alias("price"), F.col("v")[1].cast("int").alias("size"))


@query("io14_coverage", "SELECT p_brand, count(*) FILTER (WHERE p_size = 50 AND p_retailprice > 1500) AS cases FROM part GROUP BY 1")
def coverage(spark, sf_dir):
    """Brands are declared; the large dear parts are the cases of a review."""
    p = table(spark, sf_dir, "part")
    return op.coverage(p.where("p_size = 50 and p_retailprice > 1500"), p, "p_brand")


@query("io13_bundle_metadata", f"""WITH {_SUPPORT}, j AS (SELECT p_partkey, parameter, value, NOT m AND n >= 3 AS judged, m FROM l JOIN s USING (parameter, value))
SELECT p_partkey, '{{"parameters":{{' || string_agg('"' || parameter || '":{{"value":"' || value || '","judged":' || judged || '}}', ',' ORDER BY parameter) || '}},"multi":' || bool_or(m) || '}}' AS meta FROM j GROUP BY 1""")
def bundle_metadata(spark, sf_dir):
    a = _attributes(spark, sf_dir)
    return op.bundle_metadata(verdict.judged(a, "p_partkey", _PARAMS, F.col("p_size") > 40), "p_partkey", a.select("p_partkey", (F.col("p_size") > 40).alias("multi")))


@query("io14_review_rows", f"""{rules._BASE}, {rules._TYPE}, {rules._ORDER}, {rules._CLIPS}, g AS (SELECT sentence_id, string_agg('{{"place":' || place || ',"gloss":"' || gloss || '","video_id":' || coalesce(CAST(video_id AS VARCHAR), 'null') || '}}', ',' ORDER BY place) AS g FROM od LEFT JOIN pk USING (gloss) GROUP BY 1)
SELECT sentence_id, '{{"reason":' || coalesce('"' || reason || '"', 'null') || ',"glosses":[' || coalesce(g, '') || ']}}' AS review FROM ref LEFT JOIN g USING (sentence_id) WHERE reason IS NULL OR reason NOT LIKE 'unknown%'""")
def review_rows(spark, sf_dir):
    from seqloom.operators import rules as r

    lexical = rules._once(spark, sf_dir)
    cases = rules._refused(spark, sf_dir, lexical).where("reason is null or reason not like 'unknown%'")
    return op.review_rows(cases, rules._ordered(spark, sf_dir, lexical), r.pick_reference(rules._clips(spark, sf_dir)))


@query("io15_assemble_layout", """WITH d AS (SELECT l_orderkey AS frame, CASE WHEN l_tax > 0.06 AND l_suppkey % 3 = 1 THEN 2 WHEN l_tax > 0.06 AND l_suppkey % 3 = 2 THEN 1 ELSE l_suppkey % 3 END AS slot, l_discount AS score, l_quantity / 50 * 640 AS x FROM lineitem),
b AS (SELECT frame, slot, max(score) AS score, max(x) AS top, min(x) AS low FROM (SELECT *, max(score) OVER (PARTITION BY frame, slot) AS m FROM d) WHERE score = m GROUP BY 1, 2) SELECT frame, round(sum(score), 6) AS score, count(*) AS slots FROM b GROUP BY 1""")
def assemble_layout(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), (F.col("l_suppkey") % 3).cast("int").alias("slot"), F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")).alias("ord"), F.col("l_discount").alias("score"), (F.col("l_quantity") / 50).alias("x"), F.lit(0.5).alias("y"), F.lit(640).alias("width"), F.lit(480).alias("height"), (F.col("l_tax") > 0.06).alias("mirrored"))
    out = op.assemble_layout(li, 3)
    return out.select("frame", F.round(F.aggregate("score", F.lit(0.0), lambda a, x: a + x), 6).alias("score"), F.size(F.filter("kp", lambda p: p["y"] > 0)).cast("long").alias("slots"))
