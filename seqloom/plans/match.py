"""Sequence matching: ten embeddings make a clip; clips with series % 5 = 4 are the queries, the others the bank."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators import heads
from seqloom.operators import match as op
from seqloom.operators import verdict as grading
from seqloom.plans import verdict as verdicts
from seqloom.plans.bind import FRAMES, frames, table
from seqloom.plans.registry import query

_CLIPS = "clips AS (SELECT vec_id // 10 AS series, min(label) AS label, array_agg(CAST(embedding AS DOUBLE[]) ORDER BY vec_id) AS seq FROM embeddings GROUP BY 1)"
_DTW = "list_reduce({a}, lambda p, x: list_reduce({b}, lambda c, y: list_append(c, list_distance(x, y) + least(p[len(c) + 1], p[len(c)], c[len(c)])), ['inf'::DOUBLE]), list_concat([0.0::DOUBLE], list_transform({b}, lambda y: 'inf'::DOUBLE)))[len({b}) + 1] / (len({a}) + len({b}))"
_ALL = f"""{_CLIPS}, d AS (SELECT q.series AS query, q.label AS label_q, r.series AS series, r.label AS label, {_DTW.format(a='q.seq', b='r.seq')} AS distance FROM clips q JOIN clips r ON q.series % 5 = 4 AND r.series % 5 < 4)"""
_PER = "p AS (SELECT query, label_q, label, min(distance) AS distance FROM d GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), label) AS rank FROM p)"


def clips(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 10").alias("series"), (F.col("vec_id") % 10).alias("t"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("f"))
    least = e.withColumn("label", F.min("label").over(W.partitionBy("series")))
    return op.sequences(least, F.col("f"), "label")


def _sides(spark, sf_dir):
    """Queries and bank."""
    c = clips(spark, sf_dir)
    return c.where("series % 5 = 4"), c.where("series % 5 < 4")


def _distances(spark, sf_dir, band=None):
    return op.distances(*_sides(spark, sf_dir), band)


def _near(df):
    return df.withColumn("distance", F.round("distance", 9))


@query("d1_cost_matrix", f"WITH {_CLIPS} SELECT a.series, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(list_distance(a.seq[i + 1], b.seq[j + 1]), 6) AS cost FROM (SELECT *, unnest(range(0, len(seq))) AS i FROM clips) a JOIN (SELECT *, unnest(range(0, len(seq))) AS j FROM clips) b ON b.series = a.series + 1")
def cost_matrix(spark, sf_dir):
    c = clips(spark, sf_dir)
    pairs = c.select("series", F.col("seq").alias("a")).join(c.select((F.col("series") - 1).alias("series"), F.col("seq").alias("b")), "series")
    return op.cost_matrix(pairs).withColumn("cost", F.round("cost", 6))


@query("d2_dtw", f"WITH {_ALL} SELECT query, series, round(distance, 6) AS distance FROM d")
def dtw(spark, sf_dir):
    return _distances(spark, sf_dir).select("query", "series", F.round("distance", 6).alias("distance"))


_FIRST = f"""{FRAMES}, s AS (SELECT series, array_agg([energy] ORDER BY t) AS seq FROM frames GROUP BY series)"""


@query("d2_dtw_scalar", f"WITH {_FIRST} SELECT a.series, round({_DTW.format(a='a.seq', b='b.seq')}, 6) AS distance FROM s a JOIN s b ON b.series = a.series + 1")
def dtw_scalar(spark, sf_dir):
    s = op.sequences(frames(spark, sf_dir), F.col("energy"))
    pairs = s.select("series", F.col("seq").alias("a")).join(s.select((F.col("series") - 1).alias("series"), F.col("seq").alias("b")), "series")
    return pairs.select("series", F.round(op.scalar_dtw("a", "b"), 6).alias("distance"))


_BAND = "list_reduce(list_transform(range(1, len({a}) + 1), lambda i: [i::DOUBLE]), lambda p, x: list_reduce({b}, lambda c, y: list_append(c, CASE WHEN len(c) BETWEEN greatest(1, trunc(x[1] * (len({b}) / len({a})) - 2)) AND trunc(x[1] * (len({b}) / len({a})) + 2) + 1 THEN list_distance({a}[x[1]::INT], y) + least(p[len(c) + 1], p[len(c)], c[len(c)]) ELSE 'inf'::DOUBLE END), ['inf'::DOUBLE]), list_concat([0.0::DOUBLE], list_transform({b}, lambda y: 'inf'::DOUBLE)))[len({b}) + 1] / (len({a}) + len({b}))"


@query("d2_dtw_banded", f"WITH {_CLIPS} SELECT q.series AS query, r.series AS series, round({_BAND.format(a='q.seq', b='r.seq')}, 6) AS distance FROM clips q JOIN clips r ON q.series % 5 = 4 AND r.series % 5 < 4")
def dtw_banded(spark, sf_dir):
    return _distances(spark, sf_dir, band=2).select("query", "series", F.round("distance", 6).alias("distance"))


def _paths(spark, sf_dir):
    c = clips(spark, sf_dir)
    pairs = c.select("series", F.col("seq").alias("a")).join(c.select((F.col("series") - 1).alias("series"), F.col("seq").alias("b")), "series")
    return op.align(pairs, paths=True)


#: The table of cumulated costs of each pair of clips, and the path back from its end: the diagonal wins, then up.
_TRACE = f"""{_CLIPS}, pr AS (SELECT a.series, a.seq AS a, b.seq AS b FROM clips a JOIN clips b ON b.series = a.series + 1),
t AS (SELECT series, len(a) AS n, len(b) AS m, list_reduce(list_transform(a, lambda x: [x]), lambda p, x: list_append(p, list_reduce(b, lambda c, y: list_append(c, list_distance(x[1], y) + least(p[len(p)][len(c) + 1], p[len(p)][len(c)], c[len(c)])), ['inf'::DOUBLE])),
  [list_concat([0.0::DOUBLE], list_transform(b, lambda y: 'inf'::DOUBLE))]) AS d FROM pr),
r AS (SELECT series, n AS i, m AS j FROM t UNION ALL SELECT series, CASE WHEN diagonal <= up AND diagonal <= aside OR up <= aside THEN i - 1 ELSE i END, CASE WHEN diagonal <= up AND diagonal <= aside OR up > aside THEN j - 1 ELSE j END
  FROM (SELECT r.*, d[i][j] AS diagonal, d[i][j + 1] AS up, d[i + 1][j] AS aside FROM r JOIN t USING (series) WHERE i > 1 OR j > 1))"""


@query("d3_dtw_path", f"""WITH RECURSIVE {_TRACE} SELECT series, round(any_value(d[n + 1][m + 1] / (n + m)), 6) AS distance, CAST(count(*) AS INT) AS steps, string_agg((i - 1) || ':' || (j - 1), ',' ORDER BY i, j) AS path FROM r JOIN t USING (series) GROUP BY series""")
def dtw_path(spark, sf_dir):
    return _paths(spark, sf_dir).select("series", F.round("distance", 6).alias("distance"), F.size("path").alias("steps"), F.array_join(F.transform("path", lambda p: F.concat_ws(":", p["i"], p["j"])), ",").alias("path"))


@query("d4_per_label", f"WITH {_ALL} SELECT query, label, round(min(distance), 6) AS nearest, round(avg(distance), 6) AS mean FROM d GROUP BY 1, 2")
def per_label(spark, sf_dir):
    return op.summaries(*_sides(spark, sf_dir)).select("query", "label", F.round("nearest", 6).alias("nearest"), F.round("mean", 6).alias("mean"))


@query("d5_rank_all", f"WITH {_ALL}, {_PER} SELECT query, label, rank FROM k")
def rank_all(spark, sf_dir):
    return op.ranked(_near(op.nearest(*_sides(spark, sf_dir)))).select("query", "label", "rank")


def _labels(spark, sf_dir):
    return clips(spark, sf_dir).select("label").distinct()


@query("d6_target_distance", f"WITH {_ALL} SELECT query, label, round(min(distance), 6) AS distance FROM d WHERE label = label_q GROUP BY 1, 2")
def target_distance(spark, sf_dir):
    d = op.nearest(*_sides(spark, sf_dir), targets=_labels(spark, sf_dir).select(F.col("label").alias("label_q"), "label"))
    return d.select("query", "label", F.round("distance", 6).alias("distance"))


@query("d7_leave_one_out", f"""WITH {_CLIPS}, d AS (SELECT q.series AS query, r.label, min({_DTW.format(a='q.seq', b='r.seq')}) AS distance FROM clips q JOIN clips r ON q.series <> r.series AND q.series % 50 = 0 GROUP BY 1, 2)
SELECT query, label, round(distance, 6) AS distance FROM d""")
def leave_one_out(spark, sf_dir):
    """The stated query set of searches, series divisible by 50, against all others."""
    c = clips(spark, sf_dir)
    return op.nearest(c.where("series % 50 = 0"), c, others=True).select("query", "label", F.round("distance", 6).alias("distance"))


@query("d8_restricted_targets", f"WITH {_ALL} SELECT query, label, round(min(distance), 6) AS distance FROM d WHERE label = label_q OR label = (label_q + 1) % 10 GROUP BY 1, 2")
def restricted_targets(spark, sf_dir):
    wanted = _labels(spark, sf_dir).select(F.col("label").alias("label_q"), F.explode(F.array("label", ((F.col("label") + 1) % 10).cast("int"))).alias("label")).distinct()
    return op.nearest(*_sides(spark, sf_dir), targets=wanted).select("query", "label", F.round("distance", 6).alias("distance"))


@query("d9_first_references", "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n <= 5")
def first_references(spark, sf_dir):
    return op.first_references(table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("series")), 5).select("label", F.col("series").alias("vec_id"))


@query("d10_reference_bank", """WITH w AS (SELECT DISTINCT label FROM embeddings WHERE vec_id % 3 = 0 UNION SELECT 99), e AS (SELECT label, vec_id, embedding, unnest(range(0, len(embedding))) AS col FROM embeddings WHERE vec_id % 5 < 4 AND label IN (SELECT label FROM w)),
v AS (SELECT label, vec_id, CAST(col AS INT) AS col, CAST(embedding[col + 1] AS DOUBLE) AS v FROM e), f AS (SELECT col, avg(v) AS m, stddev_pop(v) AS s FROM v GROUP BY col), z AS (SELECT label, vec_id, col, (v - m) / CASE WHEN s < 1e-6 THEN 1 ELSE s END AS z FROM v JOIN f USING (col))
SELECT w.label, vec_id, col, round(z, 5) AS z, vec_id IS NULL AS missing FROM w LEFT JOIN z USING (label)""")
def reference_bank(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("series"), (F.col("vec_id") % 5 < 4).alias("train"), F.transform("embedding", lambda x: x.cast("double")).alias("feat"))
    wanted = e.where("series % 3 = 0").select("label").distinct().union(spark.createDataFrame([(99,)], "label int"))
    bank, missing = op.reference_bank(e, wanted)
    long = bank.select("label", F.col("series").alias("vec_id"), F.posexplode("feat").alias("col", "z"), F.lit(False).alias("missing"))
    return long.unionByName(missing.select("label", F.lit(True).alias("missing")), allowMissingColumns=True).withColumn("z", F.round("z", 5))


@query("d11_segments", f"WITH RECURSIVE {_TRACE} SELECT series, (j - 1) // 5 AS part, CAST(min(i) - 1 AS INT) AS start, CAST(max(i) AS INT) AS stop FROM r GROUP BY 1, 2")
def segments(spark, sf_dir):
    owner = clips(spark, sf_dir).select((F.col("series") - 1).alias("series"), F.posexplode("seq").alias("j", "f")).select("series", "j", F.expr("j div 5").alias("part"))
    p = _paths(spark, sf_dir)
    return op.segments(p, owner.join(p.select("series"), "series", "left_semi"), ["series"])


@query("d12_align_and_grade")
def align_and_grade(spark, sf_dir):
    """Attempts at two-part sentences: clips s and s + 1 joined, aligned to the reference composed of clips s + 2 and s + 3, for s of which s % 5 = 3.

    Each part's segment is trimmed again to its own motion, pooled and judged by heads, one verdict for each parameter, against what the part's own clip is
    like. Values that fewer than three clips share are not judged.
    """
    f = verdicts.clips_of_five(spark, sf_dir)
    first = f.select("series").distinct().where("series % 5 = 3")
    plan = lambda k: first.select(F.col("series").alias("seq_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("part")).withColumn("source", F.col("seq_id") + F.col("part") + k)
    attempt = op.compose(plan(0), f).select(F.col("seq_id").alias("series"), "t", "f")
    reference = op.compose(plan(2), f).select(F.col("seq_id").alias("series"), "t", "part", "f")
    clips = verdicts.profiled(spark, sf_dir)
    wanted = grading.judged(clips, "series", list(verdicts.HEADS), F.lit(False)).select(F.col("series").alias("source"), "parameter", F.col("value").alias("target"), "judged")
    targets = plan(2).join(wanted, "source").select(F.col("seq_id").alias("series"), "part", "parameter", "target", "judged")
    model = heads.fit(clips.where("series % 5 < 3"), verdicts.HEADS)
    grade = lambda rows: heads.verdicts(verdicts.pooled_clips(rows), model)
    graded = op.align_and_grade(attempt, reference, targets, grade, threshold=1.3, preroll=1, settle=1)
    return graded.withColumns({"distance": F.round("distance", 6), "confidence": F.round("confidence", 3)})


@query("d13_compose", """WITH c AS (SELECT vec_id // 10 AS series, CAST(vec_id % 10 AS INT) AS t, embedding AS f FROM embeddings), n AS (SELECT series, count(*) AS n FROM c GROUP BY 1),
pl AS (SELECT series // 3 AS seq_id, series % 3 AS part, series AS source FROM n), o AS (SELECT seq_id, part, source, coalesce(sum(n) OVER (PARTITION BY seq_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM pl JOIN n ON series = source)
SELECT seq_id, CAST(off + t AS INT) AS t, part, source, CAST(i AS INT) AS i, round(CAST(f[i + 1] AS DOUBLE), 6) AS f FROM (SELECT *, unnest(range(0, len(f))) AS i FROM o JOIN c ON c.series = o.source)""")
def compose(spark, sf_dir):
    c = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 10").alias("series"), (F.col("vec_id") % 10).cast("int").alias("t"), "embedding")
    playlist = c.select("series").distinct().select(F.expr("series div 3").alias("seq_id"), (F.col("series") % 3).alias("part"), F.col("series").alias("source"))
    framed = op.compose(playlist, c).select("seq_id", "t", "part", "source", F.posexplode("embedding").alias("i", "f"))
    return framed.withColumn("f", F.round(F.col("f").cast("double"), 6))


_GREEDY = """g AS (SELECT vec_id // 10 AS series, vec_id % 10 AS t, list_position(embedding, list_max(embedding)) - 1 AS k FROM embeddings),
w AS (SELECT *, lag(k) OVER (PARTITION BY series ORDER BY t) AS was FROM g), tok AS (SELECT series, coalesce(string_agg(CAST(k AS VARCHAR), ' ' ORDER BY t) FILTER (WHERE k <> 0 AND was IS DISTINCT FROM k), '') AS tokens FROM w GROUP BY series)"""


def _decoded(spark, sf_dir):
    f = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 10").alias("series"), (F.col("vec_id") % 10).alias("t"), "embedding")
    return op.greedy_decode(f, F.col("embedding"))  # each value is the score of a class


@query("d14_greedy_decode", f"WITH {_GREEDY} SELECT series, tokens FROM tok")
def greedy_decode(spark, sf_dir):
    return _decoded(spark, sf_dir).select("series", F.array_join(F.transform("tokens", lambda k: k.cast("string")), " ").alias("tokens"))


@query("d15_edit_distance", f"WITH {_GREEDY}, s AS (SELECT series, coalesce(array_to_string(list_transform(string_split(nullif(tokens, ''), ' '), lambda x: chr(CAST(x AS INT) + 40)), ''), '') AS c FROM tok) SELECT a.series, levenshtein(a.c, b.c) AS edits FROM s a JOIN s b ON b.series = a.series + 1")
def edit_distance(spark, sf_dir):
    d = _decoded(spark, sf_dir)
    both = d.select("series", F.col("tokens").alias("a")).join(d.select((F.col("series") - 1).alias("series"), F.col("tokens").alias("b")), "series")
    return both.select("series", op.edit_distance("a", "b").cast("long").alias("edits"))


@query("d16_word_error_rate", f"""WITH {_GREEDY}, s AS (SELECT series, coalesce(array_to_string(list_transform(string_split(nullif(tokens, ''), ' '), lambda x: chr(CAST(x AS INT) + 40)), ''), '') AS c FROM tok), e AS (SELECT levenshtein(a.c, b.c) / length(a.c) AS wer FROM s a JOIN s b ON b.series = a.series + 1 WHERE a.c <> '')
SELECT count(*) AS n, round(avg(wer), 6) AS mean, round(quantile_cont(wer, 0.5), 6) AS median FROM e""")
def word_error_rate(spark, sf_dir):
    d = _decoded(spark, sf_dir)
    both = d.select("series", F.col("tokens").alias("a")).join(d.select((F.col("series") - 1).alias("series"), F.col("tokens").alias("b")), "series")
    rates = both.where("size(a) > 0").select(op.word_error_rate("a", "b").alias("wer"))
    return rates.agg(F.count("*").alias("n"), F.round(F.avg("wer"), 6).alias("mean"), F.round(F.percentile("wer", F.lit(0.5)), 6).alias("median"))


def _forced(spark, sf_dir):
    c = clips(spark, sf_dir).select("series", F.transform("seq", lambda x: F.transform(x, lambda v: v * 3)).alias("probs"))
    d = _decoded(spark, sf_dir).select("series", F.col("tokens").alias("target"))
    return c.join(d, "series")


#: The best cumulated log probability of each state (classes with blanks around) after each frame, and the states back from the better of the last two.
_FORCED = f"""{_GREEDY}, tg AS (SELECT series, seq, CASE WHEN coalesce(tokens, '') = '' THEN CAST([] AS INT[]) ELSE list_transform(string_split(tokens, ' '), lambda x: CAST(x AS INT)) END AS target FROM (SELECT vec_id // 10 AS series, array_agg(list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * 3) ORDER BY vec_id) AS seq FROM embeddings GROUP BY 1) JOIN tok USING (series)),
u AS (SELECT *, list_transform(range(1, 2 * len(target) + 2), lambda s: CASE WHEN s % 2 = 1 THEN 0 ELSE target[s // 2] END) AS k FROM tg),
p AS (SELECT series, target, k, len(seq) AS n, list_reduce(list_transform(seq[2:], lambda x: [x]), lambda p, x: list_append(p, list_transform(range(1, len(k) + 1), lambda s: x[1][k[s] + 1] + greatest(p[len(p)][s], CASE WHEN s > 1 THEN p[len(p)][s - 1] ELSE '-inf'::DOUBLE END,
  CASE WHEN s > 2 AND k[s] <> 0 AND k[s] <> k[s - 2] THEN p[len(p)][s - 2] ELSE '-inf'::DOUBLE END))), [list_transform(range(1, len(k) + 1), lambda s: CASE WHEN s < 3 THEN seq[1][k[s] + 1] ELSE '-inf'::DOUBLE END)]) AS d FROM u),
f AS (SELECT series, n AS t, CAST(CASE WHEN len(k) > 1 AND d[n][len(k) - 1] > d[n][len(k)] THEN len(k) - 1 ELSE len(k) END AS BIGINT) AS s FROM p WHERE greatest(d[n][len(k)], CASE WHEN len(k) > 1 THEN d[n][len(k) - 1] ELSE '-inf'::DOUBLE END) > '-inf'::DOUBLE
  UNION ALL SELECT series, t - 1, CASE WHEN stay >= greatest(one, two) THEN s WHEN one >= two THEN s - 1 ELSE s - 2 END FROM (SELECT f.*, d[t - 1][s] AS stay, CASE WHEN s > 1 THEN d[t - 1][s - 1] ELSE '-inf'::DOUBLE END AS one,
  CASE WHEN s > 2 AND k[s] <> 0 AND k[s] <> k[s - 2] THEN d[t - 1][s - 2] ELSE '-inf'::DOUBLE END AS two FROM f JOIN p USING (series) WHERE t > 1)),
lb AS (SELECT series, t - 1 AS t, CASE WHEN s % 2 = 1 THEN -1 ELSE (s - 2) // 2 END AS label FROM f)"""


@query("d17_forced_align", f"WITH RECURSIVE {_FORCED} SELECT series, string_agg(CAST(label AS VARCHAR), ' ' ORDER BY t) AS labels FROM p LEFT JOIN lb USING (series) GROUP BY series")
def forced_align(spark, sf_dir):
    return op.forced_align(_forced(spark, sf_dir)).select("series", F.array_join(F.transform("labels", lambda k: k.cast("string")), " ").alias("labels"))


@query("d18_label_segments", f"""WITH RECURSIVE {_FORCED}, q AS (SELECT series, CAST(unnest(range(0, len(target))) AS INT) AS part FROM p)
SELECT q.series, part, CAST(coalesce(min(t), 0) AS INT) AS start, CAST(coalesce(max(t) + 1, 0) AS INT) AS stop FROM q LEFT JOIN lb ON lb.series = q.series AND label = part GROUP BY 1, 2""")
def label_segments(spark, sf_dir):
    rows = _forced(spark, sf_dir)
    labels = op.forced_align(rows).join(rows.select("series", F.size("target").alias("parts")), "series")
    return op.label_segments(labels, F.col("parts"))


@query("d19_sample_trials")
def sample_trials(spark, sf_dir):
    """Three clips of different labels for each customer; a clip keeps its true length."""
    c = clips(spark, sf_dir).select("series", "label", F.size("seq").alias("length"))
    trials = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("trial"))
    return op.sample_trials(c.where("series % 5 = 4"), c.where("series % 5 < 4"), trials, 3, 1)
