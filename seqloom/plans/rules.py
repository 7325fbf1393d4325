"""Token rules on the sentences (between full stops) of conversation turns: words are tokens; part of speech and dependency follow from the word by fixed rules."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators import rules as op
from seqloom.plans.bind import table
from seqloom.plans.registry import query
from seqloom.sources.store import stored

_POS = ("NOUN", "VERB", "DET", "ADJ", "PUNCT", "INTJ", "ADV", "NOUN")
_DEP = ("ROOT", "nsubj", "dobj", "neg", "advcl", "conj", "amod", "det", "relcl", "pobj", "prep", "punct", "advmod")
PHRASES = {("the", "of"): "THE_OF", ("in", "the"): "IN_THE", ("and", "the", "of"): "AND_THE_OF"}
_DROPPED = ("was", "it")
_TIME, _WH = ["G-that", "G-on"], ["G-on", "G-are"]
_KNOWN = ("the", "of", "and", "that", "on", "are", "er", "in", "to", "for")


def sentences(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\\.")).alias("k", "english"))
    return c.select((F.col("conv_id") * 1_000_000 + F.col("turn") * 10_000 + F.col("k")).alias("sentence_id"), "english")


def tokens(spark, sf_dir):
    c = sentences(spark, sf_dir).select("sentence_id", F.posexplode(F.filter(F.split("english", " "), lambda w: w != "")).alias("i", "text"))
    lemma = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    pick = lambda names, k: F.get(F.array(*[F.lit(n) for n in names]), (k % len(names)).cast("int"))
    return c.select("sentence_id", "i", "text", lemma.alias("lemma"), pick(_POS, F.length("text") + F.col("i")).alias("pos"), pick(_DEP, F.length("text") * 7 + F.col("sentence_id") * 3 + F.col("i")).alias("dep"))


def lexicon(spark):
    return spark.createDataFrame([(w, f"G-{w}") for w in _KNOWN] + [(n, n) for n in PHRASES.values()], "lemma string, gloss string")


_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_TOK = f"""st AS (SELECT conv_id, turn, string_split(coalesce(text, ''), '.') AS p FROM conversations), se AS (SELECT conv_id * 1000000 + turn * 10000 + k AS sentence_id, p[k + 1] AS english FROM (SELECT *, unnest(range(0, len(p))) AS k FROM st)),
sp AS (SELECT sentence_id, list_filter(string_split(english, ' '), lambda w: w <> '') AS w FROM se),
tk AS (SELECT sentence_id, CAST(i - 1 AS INT) AS i, w[i] AS text FROM (SELECT sentence_id, w, unnest(range(1, len(w) + 1)) AS i FROM sp)),
tok AS (SELECT sentence_id, i, text, regexp_replace(lower(text), '[^a-z]', '', 'g') AS lemma, {_LIST(_POS)}[(length(text) + i) % {len(_POS)} + 1] AS pos, {_LIST(_DEP)}[(length(text) * 7 + sentence_id * 3 + i) % {len(_DEP)} + 1] AS dep FROM tk)"""
_SCOPE = "sc AS (SELECT sentence_id, coalesce(string_agg(dep, ',' ORDER BY i) FILTER (WHERE dep IN ('relcl', 'advcl', 'ccomp', 'auxpass', 'nsubjpass') OR (dep = 'conj' AND pos IN ('VERB', 'AUX'))), '') AS problems FROM tok GROUP BY 1)"
_MERGE = """ml AS (SELECT *, lead(lemma, 1) OVER o AS l1, lead(lemma, 2) OVER o AS l2 FROM tok WINDOW o AS (PARTITION BY sentence_id ORDER BY i)),
mm AS (SELECT *, CASE WHEN lemma = 'the' AND l1 = 'of' THEN 'THE_OF' WHEN lemma = 'in' AND l1 = 'the' THEN 'IN_THE' WHEN lemma = 'and' AND l1 = 'the' AND l2 = 'of' THEN 'AND_THE_OF' END AS nm,
 CASE WHEN lemma = 'the' AND l1 = 'of' THEN 2 WHEN lemma = 'in' AND l1 = 'the' THEN 2 WHEN lemma = 'and' AND l1 = 'the' AND l2 = 'of' THEN 3 END AS sz FROM ml),
fo AS (SELECT sentence_id, list_reduce(list_transform(array_agg({'a': i, 'b': i + sz - 1} ORDER BY i), lambda x: {'upto': x.b, 'k': [x]}), lambda s, x: CASE WHEN x.k[1].a > s.upto THEN {'upto': x.upto, 'k': list_concat(s.k, x.k)} ELSE s END).k AS k FROM mm WHERE nm IS NOT NULL GROUP BY 1),
mt AS (SELECT mm.sentence_id, i, text, pos, dep, CASE WHEN len(list_filter(coalesce(k, []), lambda x: x.a = i)) > 0 THEN nm ELSE lemma END AS lemma FROM mm LEFT JOIN fo USING (sentence_id) WHERE len(list_filter(coalesce(k, []), lambda x: i > x.a AND i <= x.b)) = 0)"""
_LEX = f"""lx AS (SELECT unnest({_LIST(_KNOWN)}) AS lemma, 'G-' || unnest({_LIST(_KNOWN)}) AS gloss UNION ALL SELECT unnest({_LIST(PHRASES.values())}), unnest({_LIST(PHRASES.values())})),
lt AS (SELECT mt.*, gloss, CASE WHEN dep = 'neg' THEN 'negation' WHEN lemma IN ('was', 'it') OR pos IN ('DET', 'AUX', 'PART', 'PUNCT', 'SPACE') THEN 'dropped' WHEN gloss IS NOT NULL THEN 'kept' WHEN pos IN ('NOUN', 'VERB', 'ADJ', 'ADV', 'PROPN', 'PRON', 'NUM') THEN 'unknown' ELSE 'ignored' END AS outcome FROM mt LEFT JOIN lx USING (lemma))"""
_REF = """rf AS (SELECT se.sentence_id, english, coalesce(problems, '') AS problems, count(*) FILTER (WHERE outcome = 'negation') AS neg, count(*) FILTER (WHERE outcome = 'kept') AS n_kept, string_agg(text, ',' ORDER BY i) FILTER (WHERE outcome = 'unknown') AS u FROM se LEFT JOIN sc USING (sentence_id) LEFT JOIN lt USING (sentence_id) GROUP BY 1, 2, 3),
rs AS (SELECT sentence_id, english, n_kept, neg, CASE WHEN trim(coalesce(english, '')) = '' THEN 'empty' WHEN problems <> '' THEN 'unsupported: ' || problems WHEN u IS NOT NULL THEN 'unknown: ' || u WHEN n_kept = 0 THEN 'no content' END AS reason FROM rf),
ref AS (SELECT sentence_id, english, n_kept, neg > 0 AND coalesce(reason, '') NOT LIKE 'empty%' AND coalesce(reason, '') NOT LIKE 'unsupported%' AS negated, reason FROM rs)"""
_BASE = f"WITH {_TOK}, {_SCOPE}, {_MERGE}, {_LEX}, {_REF}"
_TYPE = f"ty AS (SELECT se.sentence_id, CASE WHEN list_has_any(coalesce(array_agg(gloss) FILTER (WHERE outcome = 'kept'), []), {_LIST(_WH)}) THEN 'wh_question' WHEN suffix(trim(english), '?') OR se.sentence_id % 5 = 0 THEN 'yes_no_question' ELSE 'statement' END AS type FROM se JOIN lt USING (sentence_id) GROUP BY se.sentence_id, english)"
_ORDER = f"od AS (SELECT sentence_id, i, gloss, pos, type, row_number() OVER (PARTITION BY sentence_id ORDER BY CASE WHEN type = 'wh_question' AND gloss IN ('G-on', 'G-are') THEN 2 WHEN gloss IN ('G-that', 'G-on') THEN 0 ELSE 1 END, i) - 1 AS place FROM lt JOIN ty USING (sentence_id) WHERE outcome = 'kept')"


def _merged(spark, sf_dir):
    return op.merge_phrases(tokens(spark, sf_dir), PHRASES)


def _lexical(spark, sf_dir):
    return op.lexicalise(_merged(spark, sf_dir), lexicon(spark), _DROPPED)


def _once(spark, sf_dir):
    """The tokens with their outcomes, stored: several branches of a plan need them."""
    return stored(_lexical(spark, sf_dir).select("sentence_id", "i", "text", "pos", "gloss", "outcome"), "lexical")


def _refused(spark, sf_dir, lexical):
    return op.refusals(sentences(spark, sf_dir), op.scope(tokens(spark, sf_dir)), lexical)


def _type(glosses):
    asked = F.when(F.col("sentence_id") % 5 == 0, F.concat("english", F.lit("?"))).otherwise(F.col("english"))
    return op.sentence_type(glosses, asked, _WH)


def _typed(spark, sf_dir, lexical):
    g = lexical.groupBy("sentence_id").agg(F.collect_list(F.when(F.col("outcome") == "kept", F.col("gloss"))).alias("glosses"))
    df = g.join(sentences(spark, sf_dir), "sentence_id")
    return df.select("sentence_id", _type(F.col("glosses")).alias("type"))


def _ordered(spark, sf_dir, lexical):
    whole = F.collect_list(F.when(F.col("outcome") == "kept", F.col("gloss"))).over(W.partitionBy("sentence_id"))
    kept = lexical.withColumn("glosses", whole).where("outcome = 'kept'").join(sentences(spark, sf_dir), "sentence_id")
    return op.reorder(kept.withColumn("type", _type(F.col("glosses"))).drop("glosses", "english"), _TIME, _WH)


def _negated(spark, sf_dir):
    """The ordered glosses with whether their sentence is negated."""
    lexical = _once(spark, sf_dir)
    return _ordered(spark, sf_dir, lexical).join(_refused(spark, sf_dir, lexical).select("sentence_id", "negated"), "sentence_id")


@query("r1_scope", f"WITH {_TOK}, {_SCOPE} SELECT sentence_id, problems FROM sc")
def scope(spark, sf_dir):
    return op.scope(tokens(spark, sf_dir))


@query("r2_merge_phrases", f"WITH {_TOK}, {_MERGE} SELECT sentence_id, i, lemma, text FROM mt")
def merge_phrases(spark, sf_dir):
    return _merged(spark, sf_dir).select("sentence_id", "i", "lemma", "text")


@query("r3_lexicalise", f"WITH {_TOK}, {_MERGE}, {_LEX} SELECT sentence_id, i, gloss, outcome FROM lt")
def lexicalise(spark, sf_dir):
    return _lexical(spark, sf_dir).select("sentence_id", "i", "gloss", "outcome")


@query("r4_refusals", f"{_BASE} SELECT sentence_id, negated, n_kept, reason FROM ref")
def refusals(spark, sf_dir):
    return _refused(spark, sf_dir, _lexical(spark, sf_dir))


@query("r5_sentence_type", f"{_BASE}, {_TYPE} SELECT sentence_id, type FROM ty")
def sentence_type(spark, sf_dir):
    return _typed(spark, sf_dir, _lexical(spark, sf_dir))


@query("r6_reorder", f"{_BASE}, {_TYPE}, {_ORDER} SELECT sentence_id, i, gloss, place FROM od")
def reorder(spark, sf_dir):
    return _ordered(spark, sf_dir, _lexical(spark, sf_dir)).select("sentence_id", "i", "gloss", "place")


@query("r7_spans", f"""{_BASE}, {_TYPE}, {_ORDER}, g AS (SELECT sentence_id, type, negated, count(*) AS n, min(place) FILTER (WHERE pos = 'VERB') AS verb FROM od JOIN ref USING (sentence_id) GROUP BY 1, 2, 3)
SELECT sentence_id, n, concat_ws(',', CASE type WHEN 'wh_question' THEN 'brow_furrow:0:' || n WHEN 'yes_no_question' THEN 'brow_raise:0:' || n END, CASE WHEN negated THEN 'headshake:' || coalesce(verb, 0) || ':' || n END) AS spans FROM g""")
def spans(spark, sf_dir):
    return op.spans(_negated(spark, sf_dir))


@query("r8_confidence", f"""{_BASE}, {_TYPE}, {_ORDER}, f AS (SELECT sentence_id, CAST(max(type) <> 'statement' AS INT) + CAST(bool_or(negated) AS INT) + CAST(bool_or(gloss IN ('G-that', 'G-on')) AS INT) AS f FROM od JOIN ref USING (sentence_id) GROUP BY 1)
SELECT sentence_id, round(CASE WHEN f <= 1 THEN 1.0 ELSE greatest(0.4, 1 - 0.15 * (f - 1)) END, 6) AS confidence FROM f""")
def confidence(spark, sf_dir):
    g = _negated(spark, sf_dir).groupBy("sentence_id").agg((F.max("type") != "statement").cast("int").alias("q"), F.bool_or("negated").cast("int").alias("n"), F.bool_or(F.col("gloss").isin(*_TIME)).cast("int").alias("t"))
    return g.select("sentence_id", F.round(op.confidence(F.col("q") + F.col("n") + F.col("t")), 6).alias("confidence"))


@query("r9_topicalise", f"""{_BASE}, {_TYPE}, {_ORDER}, q AS (SELECT sentence_id, array_agg(gloss ORDER BY place) AS g, max(type) AS type, bool_and(reason IS NULL OR reason LIKE 'unknown%') AS ok, max(sentence_id % 4) AS ix FROM od JOIN ref USING (sentence_id) GROUP BY 1)
SELECT sentence_id, CASE WHEN ok AND ix < len(g) THEN array_to_string(list_concat([g[ix + 1]], list_concat(g[1:ix], g[ix + 2:])), ' ') END AS glosses, CASE WHEN ok AND ix < len(g) THEN concat_ws(',', 'brow_raise:0:1', CASE WHEN type = 'wh_question' THEN 'brow_furrow:0:' || len(g) END) END AS spans,
 CASE WHEN NOT ok THEN 'out of scope' WHEN ix >= len(g) THEN 'no such place' END AS reason FROM q""")
def topicalise(spark, sf_dir):
    lexical = _once(spark, sf_dir)
    r = _refused(spark, sf_dir, lexical).select("sentence_id", (F.col("reason").isNull() | F.col("reason").startswith("unknown")).alias("in_scope"))
    g = _ordered(spark, sf_dir, lexical).groupBy("sentence_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "gloss"))), lambda x: x["gloss"]).alias("glosses"), F.max("type").alias("type")).join(r, "sentence_id")
    return op.topicalise(g, (F.col("sentence_id") % 4).cast("int"))


@query("r10_display", "SELECT p_partkey, replace(upper(regexp_replace(CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '_') || '_' || p_size ELSE replace(p_name, ' ', '_') END, '_\\d+$', '')), '_', '-') AS shown FROM part")
def display(spark, sf_dir):
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return table(spark, sf_dir, "part").select("p_partkey", op.display(F.when(F.col("p_size") % 2 == 0, F.concat(name, F.lit("_"), "p_size")).otherwise(name)).alias("shown"))


@query("r11_build_lexicon", """WITH o AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS lemma, p_brand AS gloss FROM part WHERE p_size < 3), s(lemma, o) AS (VALUES ('crimson', 'red'), ('azure', 'blue'), ('none', 'nothing'))
SELECT lemma, gloss FROM o UNION SELECT s.lemma, gloss FROM s JOIN o ON o.lemma = s.o UNION SELECT DISTINCT p_brand, p_brand FROM part WHERE p_size < 3 AND p_brand = 'Brand#1'""")
def build_lexicon(spark, sf_dir):
    items = table(spark, sf_dir, "part").where("p_size < 3").select(F.split("p_name", " ").alias("lemmas"), F.col("p_brand").alias("gloss"))
    synonyms = spark.createDataFrame([("crimson", "red"), ("azure", "blue"), ("none", "nothing")], "lemma string, of string")
    return op.build_lexicon(items, synonyms, {("brand", "one"): "Brand#1"})


@query("r12_surface_forms", """WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS lemma FROM documents WHERE lang = 'en'), f AS (SELECT lemma, CASE WHEN lemma IN ('the', 'of') THEN [lemma] ELSE
 list_concat(list_concat(list_concat([lemma, lemma || 's', lemma || 'ing', lemma || 'ed'], CASE WHEN lemma = 'go' THEN ['went', 'gone'] ELSE [] END), CASE WHEN regexp_matches(lemma, '(s|sh|ch|x|o)$') THEN [lemma || 'es'] ELSE [] END),
 list_concat(CASE WHEN regexp_matches(lemma, '(^|[^aeiou])y$') THEN [lemma[:-2] || 'ies', lemma[:-2] || 'ied'] ELSE [] END, CASE WHEN suffix(lemma, 'e') THEN [lemma[:-2] || 'ing', lemma || 'd'] ELSE [] END)) END AS forms FROM w)
SELECT lemma, count(DISTINCT x) AS n_forms, md5(string_agg(DISTINCT x, ',' ORDER BY x)) AS forms FROM (SELECT lemma, unnest(forms) AS x FROM f) GROUP BY lemma""")
def surface_forms(spark, sf_dir):
    w = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("l")).select(F.lower("l").alias("lemma")).distinct()
    forms = op.surface_forms(F.col("lemma"), F.col("lemma").isin("the", "of"), F.when(F.col("lemma") == "go", F.array(F.lit("went"), F.lit("gone"))))
    return w.select("lemma", F.array_sort(forms).alias("f")).select("lemma", F.size("f").cast("long").alias("n_forms"), F.md5(F.array_join("f", ",").cast("binary")).alias("forms"))


_CLIPS = "cl AS (SELECT 'G-' || w AS gloss, p_partkey AS video_id, CASE WHEN p_size % 3 = 0 THEN 'train' ELSE 'val' END AS split, p_partkey AS row_no, p_size AS n_frames FROM (SELECT *, ['the', 'of', 'and', 'that', 'on', 'er', 'in', 'to'][p_partkey % 8 + 1] AS w FROM part)), pk AS (SELECT gloss, video_id, n_frames, count(*) OVER (PARTITION BY gloss) AS n_available FROM cl QUALIFY row_number() OVER (PARTITION BY gloss ORDER BY split <> 'train', row_no) = 1)"


def _clips(spark, sf_dir):
    w = F.get(F.array(*[F.lit(x) for x in ("the", "of", "and", "that", "on", "er", "in", "to")]), (F.col("p_partkey") % 8).cast("int"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("G-"), w).alias("gloss"), F.col("p_partkey").alias("video_id"), F.when(F.col("p_size") % 3 == 0, "train").otherwise("val").alias("split"), F.col("p_partkey").alias("row_no"), F.col("p_size").alias("n_frames"))


@query("r13_pick_reference", f"WITH {_CLIPS} SELECT gloss, video_id, n_available FROM pk")
def pick_reference(spark, sf_dir):
    return op.pick_reference(_clips(spark, sf_dir))


@query("r14_resolve_sequences", f"""{_BASE}, {_TYPE}, {_ORDER}, {_CLIPS}, j AS (SELECT sentence_id, place, video_id, CASE WHEN video_id IS NULL THEN 'no clip: ' || gloss WHEN video_id % 3 = 1 THEN 'not cached: ' || gloss END AS miss FROM od LEFT JOIN pk USING (gloss))
SELECT sentence_id, count(miss) = 0 AS ok, coalesce(string_agg(miss, '; ' ORDER BY place), '') AS reasons, CASE WHEN count(miss) = 0 THEN string_agg(CAST(video_id AS VARCHAR), ',' ORDER BY place) END AS clips FROM j GROUP BY 1""")
def resolve_sequences(spark, sf_dir):
    c = _clips(spark, sf_dir)
    return op.resolve_sequences(_ordered(spark, sf_dir, _lexical(spark, sf_dir)), op.pick_reference(c), c.where("video_id % 3 <> 1"))


@query("r15_playlist", f"""{_BASE}, {_TYPE}, {_ORDER}, {_CLIPS} SELECT sentence_id, place, video_id, CAST(sum(n_frames) OVER (PARTITION BY sentence_id ORDER BY place) - n_frames AS BIGINT) AS start, CAST(sum(n_frames) OVER (PARTITION BY sentence_id ORDER BY place) AS BIGINT) AS stop FROM od JOIN pk USING (gloss)""")
def playlist(spark, sf_dir):
    c = _clips(spark, sf_dir)
    picked = op.pick_reference(c).join(c.select("video_id", "n_frames"), "video_id")
    return op.playlist(_ordered(spark, sf_dir, _lexical(spark, sf_dir)).join(picked, "gloss")).select("sentence_id", "place", "video_id", "start", "stop")


@query("r16_trace", f"""{_BASE} SELECT sentence_id, list_reduce(list_transform(list_filter([CASE WHEN negated THEN 'negated' END, n_kept || ' kept', CASE WHEN reason IS NOT NULL THEN 'refused, ' || reason END], lambda x: x IS NOT NULL), lambda x, k: k || '. ' || x), lambda a, x: a || chr(10) || x) AS trace FROM ref""")
def trace(spark, sf_dir):
    r = _refused(spark, sf_dir, _lexical(spark, sf_dir))
    return r.select("sentence_id", op.trace([F.when(F.col("negated"), "negated"), F.concat("n_kept", F.lit(" kept")), F.concat(F.lit("refused, "), "reason")]).alias("trace"))


@query("r17_acceptance", f"""{_BASE} SELECT sentence_id, CASE WHEN reason LIKE 'unsupported%' THEN 'refused' WHEN NOT (english LIKE '% the %') THEN 'off_target' WHEN (sentence_id * 37) % 50 / 10 < 2.5 THEN 'nonsense' ELSE 'shown' END AS outcome FROM ref""")
def acceptance(spark, sf_dir):
    r = _refused(spark, sf_dir, _lexical(spark, sf_dir)).join(sentences(spark, sf_dir), "sentence_id")
    scoped = ~F.coalesce(F.col("reason").startswith("unsupported"), F.lit(False))
    return r.select("sentence_id", op.acceptance(scoped, F.contains("english", F.lit(" the ")), (F.col("sentence_id") * 37) % 50 / 10).alias("outcome"))


@query("r18_refill", "SELECT p_brand AS name, count(*) AS size, min(p_retailprice) AS tried FROM part GROUP BY 1 ORDER BY size, tried, name LIMIT 1")
def refill(spark, sf_dir):
    return op.refill(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("size"), F.min("p_retailprice").alias("tried")))
