"""Token-table rules and retrieval: scope, phrases, lexicon, refusal, order, span tags, clip choice, playlists.

``tokens`` has sentence_id, i (order), text, lemma, pos, dep; the parse itself is an input. Sentences are short, so steps that
look at neighbours use windows over one sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Dependency labels that are out of scope; parts of speech that are dropped, and that need a lexicon entry.
UNSUPPORTED = ("relcl", "advcl", "ccomp", "auxpass", "nsubjpass")
DROPPED_POS = ("DET", "AUX", "PART", "PUNCT", "SPACE")
CONTENT_POS = ("NOUN", "VERB", "ADJ", "ADV", "PROPN", "PRON", "NUM")


def by_order():
    return W.partitionBy("sentence_id").orderBy("i")


def scope(tokens: DataFrame) -> DataFrame:
    """sentence_id, problems: out-of-scope labels in token order, joined by commas; empty when all is in scope."""
    bad = F.col("dep").isin(*UNSUPPORTED) | ((F.col("dep") == "conj") & F.col("pos").isin("VERB", "AUX"))
    g = tokens.groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.when(bad, F.struct("i", "dep")))).alias("p"))
    return g.select("sentence_id", F.array_join(F.transform("p", lambda x: x["dep"]), ",").alias("problems"))


def merge_phrases(tokens: DataFrame, phrases: dict[tuple[str, ...], str]) -> DataFrame:
    """Tokens with each phrase of lemmas merged into its first token, greedily from the left; the merged lemma is the phrase's name.

    A match that starts inside an earlier match is no match; that is settled by a fold over the sentence's matches in order.
    """
    found = F.lit(None).cast("string")
    size = F.lit(1)
    for words, name in reversed(list(phrases.items())):
        hit = F.lit(True)
        for k, w in enumerate(words):
            hit = hit & (F.lead("lemma", k).over(by_order()) == w)
        hit = F.coalesce(hit, F.lit(False))
        found, size = F.when(hit, F.lit(name)).otherwise(found), F.when(hit, F.lit(len(words))).otherwise(size)
    df = tokens.withColumns({"_name": found, "_size": size, "_pos": F.row_number().over(by_order())})
    # the sentence's matches stand beside each of its tokens, so the tokens are shuffled and sorted once
    matches = F.collect_list(F.when(F.col("_name").isNotNull(), F.struct("_pos", "_size"))).over(W.partitionBy("sentence_id"))
    kept = F.expr("aggregate(array_sort(m), named_struct('to', 0, 'k', cast(array() as array<struct<a: int, b: int>>)), (s, x) -> if(x._pos > s.to, named_struct('to', x._pos + x._size - 1, 'k', array_append(s.k, named_struct('a', x._pos, 'b', x._pos + x._size - 1))), s), s -> s.k)")
    df = df.withColumn("m", matches).withColumn("k", kept).drop("m")
    begins, inside = F.exists("k", lambda x: x["a"] == F.col("_pos")), F.exists("k", lambda x: (F.col("_pos") > x["a"]) & (F.col("_pos") <= x["b"]))
    return df.where(~inside).withColumn("lemma", F.when(begins, F.col("_name")).otherwise(F.col("lemma"))).drop("_name", "_size", "_pos", "k")


def lexicalise(tokens: DataFrame, lexicon: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds outcome (negation, dropped, kept, unknown, ignored) and gloss; ``lexicon`` has lemma, gloss, one row for each lemma."""
    df = tokens.join(lexicon.select("lemma", "gloss"), "lemma", "left")
    outcome = (
        F.when(F.col("dep") == "neg", "negation").when(F.col("lemma").isin(*drop) if drop else F.lit(False), "dropped").when(F.col("pos").isin(*DROPPED_POS), "dropped")
        .when(F.col("gloss").isNotNull(), "kept").when(F.col("pos").isin(*CONTENT_POS), "unknown").otherwise("ignored")
    )
    return df.withColumn("outcome", outcome)


def refusals(sentences: DataFrame, scoped: DataFrame, tokens: DataFrame) -> DataFrame:
    """sentence_id, negated, n_kept, reason (null if accepted): empty, out of scope, unknown words, nothing left, in this order."""
    g = tokens.groupBy("sentence_id").agg(
        F.count_if(F.col("outcome") == "negation").alias("neg"), F.count_if(F.col("outcome") == "kept").alias("n_kept"), F.array_sort(F.collect_list(F.when(F.col("outcome") == "unknown", F.struct("i", "text")))).alias("u")
    )
    df = sentences.join(scoped, "sentence_id", "left").join(g, "sentence_id", "left")
    unknown = F.array_join(F.transform("u", lambda x: x["text"]), ",")
    reason = F.when(F.trim(F.coalesce("english", F.lit(""))) == "", "empty").when(F.coalesce("problems", F.lit("")) != "", F.concat(F.lit("unsupported: "), "problems"))
    reason = reason.when(F.coalesce(F.size("u"), F.lit(0)) > 0, F.concat(F.lit("unknown: "), unknown)).when(F.coalesce("n_kept", F.lit(0)) == 0, "no content")
    late = ~(F.coalesce(reason, F.lit("")).startswith("empty") | F.coalesce(reason, F.lit("")).startswith("unsupported"))
    return df.select("sentence_id", (late & (F.coalesce("neg", F.lit(0)) > 0)).alias("negated"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"), reason.alias("reason"))


def sentence_type(glosses: Column, english: Column, wh: list[str]) -> Column:
    return F.when(F.arrays_overlap(glosses, F.array(*[F.lit(x) for x in wh])), "wh_question").when(F.endswith(F.trim(english), F.lit("?")), "yes_no_question").otherwise("statement")


def reorder(kept: DataFrame, time: list[str], wh: list[str]) -> DataFrame:
    """Adds place: time words first, question words last in wh questions, else the given order. ``kept`` has sentence_id, i, gloss, type."""
    bucket = F.when((F.col("type") == "wh_question") & F.col("gloss").isin(*wh), 2).when(F.col("gloss").isin(*time), 0).otherwise(1)
    return kept.withColumn("place", F.row_number().over(W.partitionBy("sentence_id").orderBy(bucket, "i")) - 1)


def spans(ordered: DataFrame) -> DataFrame:
    """sentence_id, n, spans ("marker:start:end" joined by commas); ``ordered`` has sentence_id, place, pos, type, negated."""
    g = ordered.groupBy("sentence_id", "type", "negated").agg(F.count("*").alias("n"), F.min(F.when(F.col("pos") == "VERB", F.col("place"))).alias("verb"))
    brow = F.when(F.col("type") == "wh_question", F.concat(F.lit("brow_furrow:0:"), "n")).when(F.col("type") == "yes_no_question", F.concat(F.lit("brow_raise:0:"), "n"))
    shake = F.when(F.col("negated"), F.concat(F.lit("headshake:"), F.coalesce("verb", F.lit(0)), F.lit(":"), "n"))
    return g.select("sentence_id", "n", F.concat_ws(",", brow, shake).alias("spans"))


def confidence(features: Column) -> Column:
    """1 with at most one feature, then 0.15 less for each, at least 0.4."""
    return F.when(features <= 1, 1.0).otherwise(F.greatest(F.lit(0.4), 1 - 0.15 * (features - 1)))


def topicalise(sequences: DataFrame, index: Column) -> DataFrame:
    """glosses with the one at ``index`` in front and spans with brow_raise:0:1; null, with a reason, where it is refused.

    ``sequences`` has sentence_id, glosses (array), type, in_scope.
    """
    ok = F.col("in_scope") & (F.col("_i") >= 0) & (F.col("_i") < F.size("glosses"))
    df = sequences.withColumn("_i", index)
    moved = F.expr("concat(array(get(glosses, _i)), filter(glosses, (x, k) -> k <> _i))")
    tag = F.when(F.col("type") == "wh_question", F.concat(F.lit("brow_furrow:0:"), F.size("glosses"))).otherwise("")
    return df.select("sentence_id", F.when(ok, F.array_join(moved, " ")).alias("glosses"), F.when(ok, F.concat_ws(",", F.lit("brow_raise:0:1"), F.nullif(tag, F.lit("")))).alias("spans"), F.when(~F.col("in_scope"), "out of scope").when(~ok, "no such place").alias("reason"))


def display(identifier: Column) -> Column:
    return F.upper(F.replace(F.regexp_replace(identifier, r"_\d+$", ""), F.lit("_"), F.lit("-")))


def build_lexicon(items: DataFrame, synonyms: DataFrame, phrases: dict[tuple[str, ...], str]) -> DataFrame:
    """lemma, gloss: each item's lemmas (array) in lower case, synonyms of lemmas that exist, and names of phrases that are items."""
    own = items.select(F.explode("lemmas").alias("l"), "gloss").select(F.lower("l").alias("lemma"), "gloss")
    more = synonyms.join(own.withColumnRenamed("lemma", "of"), "of").select("lemma", "gloss")
    named = items.where(F.col("gloss").isin(*phrases.values()) if phrases else F.lit(False)).select(F.col("gloss").alias("lemma"), "gloss")
    return own.unionByName(more).unionByName(named).distinct()


def surface_forms(lemma: Column, fixed: Column, irregular: Column) -> Column:
    """Plural, -ing and -ed forms of a lemma as an array without repeats; ``fixed`` lemmas have only themselves, ``irregular`` adds forms."""
    add = lambda *ends: F.array(*[F.concat(lemma, F.lit(e)) for e in ends])
    none = F.expr("cast(array() as array<string>)")
    stem = F.substring(lemma, 1, 100).substr(F.lit(1), F.length(lemma) - 1)
    forms = F.concat(
        add("", "s", "ing", "ed"), F.coalesce(irregular, none),
        F.when(lemma.rlike("(s|sh|ch|x|o)$"), add("es")).otherwise(none),
        F.when(lemma.rlike("(^|[^aeiou])y$"), F.array(F.concat(stem, F.lit("ies")), F.concat(stem, F.lit("ied")))).otherwise(none),
        F.when(lemma.endswith("e"), F.array(F.concat(stem, F.lit("ing")), F.concat(lemma, F.lit("d")))).otherwise(none),
    )
    return F.array_distinct(F.when(fixed, F.array(lemma)).otherwise(forms))


def pick_reference(clips: DataFrame) -> DataFrame:
    """gloss, video_id, n_available: a clip of the train split if there is one, else the first; ``clips`` has gloss, video_id, split, row_no."""
    w = W.partitionBy("gloss").orderBy((F.col("split") == "train").desc(), "row_no")
    df = clips.withColumns({"_r": F.row_number().over(w), "n_available": F.count("*").over(W.partitionBy("gloss"))})
    return df.where("_r = 1").select("gloss", "video_id", "n_available")


def resolve_sequences(sequences: DataFrame, picks: DataFrame, cached: DataFrame) -> DataFrame:
    """sentence_id, ok, reasons, clips: a sequence resolves only if every gloss has a clip that is cached. ``sequences`` has sentence_id, place, gloss."""
    df = sequences.join(picks.select("gloss", "video_id"), "gloss", "left").join(cached.select("video_id").distinct().withColumn("_c", F.lit(True)), "video_id", "left")
    miss = F.when(F.col("video_id").isNull(), F.concat(F.lit("no clip: "), "gloss")).when(F.col("_c").isNull(), F.concat(F.lit("not cached: "), "gloss"))
    g = df.withColumn("miss", miss).groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.when(F.col("miss").isNotNull(), F.struct("place", "miss")))).alias("m"), F.array_sort(F.collect_list(F.struct("place", "video_id"))).alias("v"))
    ok = F.size("m") == 0
    return g.select("sentence_id", ok.alias("ok"), F.array_join(F.transform("m", lambda x: x["miss"]), "; ").alias("reasons"), F.when(ok, F.array_join(F.transform("v", lambda x: x["video_id"].cast("string")), ",")).alias("clips"))


def playlist(clips: DataFrame) -> DataFrame:
    """Adds start and stop (frames) of each clip in its sequence; ``clips`` has sentence_id, place, n_frames."""
    run = F.sum("n_frames").over(W.partitionBy("sentence_id").orderBy("place"))
    return clips.withColumns({"start": run - F.col("n_frames"), "stop": run})


def trace(steps: list[Column]) -> Column:
    """The steps that have something to say, numbered, as lines."""
    said = F.array_compact(F.array(*steps))
    return F.array_join(F.transform(said, lambda s, k: F.concat((k + 1).cast("string"), F.lit(". "), s)), "\n")


def acceptance(in_scope: Column, has_target: Column, score: Column, least: float = 2.5) -> Column:
    return F.when(~in_scope, "refused").when(~has_target, "off_target").when(F.coalesce(score < least, F.lit(True)), "nonsense").otherwise("shown")


def refill(pools: DataFrame) -> DataFrame:
    """The pool to fill next: the smallest, then the longest untried, then by name; ``pools`` has name, size, tried."""
    return pools.orderBy("size", F.col("tried").asc_nulls_first(), "name").limit(1)
