"""Learner model and scheduling: ordered mastery, spacing, due items, contrast pairs, next item.

``attempts`` has learner, item, ord (order within the learner) and correct (null: not judged), one row for each judged parameter
of an attempt; several rows may share an order. A history is one item's attempts by one learner; its folds (``fold.py``) hold a state, never the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators.fold import affine, fold

START, STEP = 0.5, 0.3
EASE, EASE_LEAST, EASE_MOST, EASE_UP, EASE_DOWN = 2.5, 1.3, 3.0, 0.05, 0.2
SECOND, LONGEST = 3, 40
FLOOR, HIGH, REDIRECT = 0.05, 0.8, 0.5
#: Orders that stand together in a piece of a history.
PIECE = 65_536


def mastery(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mastery, attempts: exponential average of correct (1) and wrong (0), null skipped, from ``START``; a history may be of any length and is joined from pieces."""
    seen = attempts.where("correct is not null").select(*keys, "ord", F.col("correct").cast("double").alias("mastery"))
    whole = attempts.schema["ord"].dataType.typeName() in ("byte", "short", "integer", "long")
    return affine(seen, keys, ["ord"], "mastery", 1 - STEP, START, F.expr(f"ord div {PIECE}") if whole else None).withColumnRenamed("n", "attempts")


def item_mastery(parameters: DataFrame, items: DataFrame) -> DataFrame:
    """learner, item, mastery, attempts: mean over the attempted parameters, ``START`` for items never attempted."""
    # summed in the parameters' order, so that the result is the same to the last bit whatever the partitions
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("parameter", "mastery"))), lambda x: x["mastery"])
    mean = F.aggregate(in_order, F.lit(0.0), lambda a, x: a + x) / F.count("*")
    g = parameters.groupBy("learner", "item").agg(mean.alias("m"), F.sum("attempts").alias("n"))
    return items.join(g, ["learner", "item"], "left").select("learner", "item", F.coalesce("m", F.lit(START)).alias("mastery"), F.coalesce("n", F.lit(0)).alias("attempts"))


def passes(attempts: DataFrame) -> DataFrame:
    """learner, item, ord, good: whether all judged parameters of an attempt were right; nothing judged is a pass."""
    return attempts.groupBy("learner", "item", "ord").agg(F.coalesce(F.bool_and("correct"), F.lit(True)).alias("good"))


def advance_spacing(s: tuple[int, int, float], good: bool) -> tuple[int, int, float]:
    """repetitions, interval, ease after a pass or a miss; intervals are rounded half to even."""
    reps, interval, ease = s
    if not good:
        return 0, 1, max(EASE_LEAST, ease - EASE_DOWN)
    interval = 1 if reps == 0 else SECOND if reps == 1 else min(LONGEST, round(interval * ease))
    return reps + 1, interval, min(EASE_MOST, ease + EASE_UP)


def spacing(passed: DataFrame) -> DataFrame:
    """learner, item, repetitions, interval, ease after all passes and misses in order; a history passes through its task in batches."""
    kinds = ", ".join(f"{c} {passed.schema[c].dataType.simpleString()}" for c in ("learner", "item"))
    return fold(passed, ["learner", "item"], ["ord"], ["good"], lambda: (0, 1, EASE), advance_spacing, lambda s: [s], f"{kinds}, repetitions int, interval int, ease double")


def due(passed: DataFrame, spaced: DataFrame, items: DataFrame) -> DataFrame:
    """learner, item, clock, last_seen, due_at, is_due: the clock counts a learner's attempts; an item never seen is due."""
    at = passed.withColumn("tick", F.row_number().over(W.partitionBy("learner").orderBy("ord", "item")))
    clock = at.groupBy("learner").agg(F.max("tick").alias("clock"))
    last = at.groupBy("learner", "item").agg(F.max("tick").alias("last_seen"))
    df = items.join(clock, "learner", "left").join(last, ["learner", "item"], "left").join(spaced.select("learner", "item", "interval"), ["learner", "item"], "left")
    when = F.col("last_seen") + F.col("interval")
    return df.select("learner", "item", F.coalesce("clock", F.lit(0)).alias("clock"), "last_seen", when.alias("due_at"), (when.isNull() | (F.col("clock") >= when)).alias("is_due"))


def partners(pairs: DataFrame) -> DataFrame:
    """item, field, partner: the first pair of each item and field, in either direction; ``pairs`` has a, b, field."""
    both = pairs.select(F.col("a").alias("item"), "field", F.col("b").alias("partner"), "a", "b").union(pairs.select(F.col("b"), "field", F.col("a"), "a", "b"))
    return both.withColumn("_r", F.row_number().over(W.partitionBy("item", "field").orderBy("a", "b"))).where("_r = 1").select("item", "field", "partner")


def next_item(pool: DataFrame, last: DataFrame, contrast: DataFrame, seed: int) -> DataFrame:
    """learner, item, reason: what each learner should do next.

    ``pool`` has learner, item, clock, is_due, mastery; ``last`` learner, item, field (of the last mistake, null without one);
    ``contrast`` item, field, partner. A contrast to the last mistake comes first if its partner is in the pool. Else the smallest
    -ln(u) / weight among due items (all, if none is due) wins, which draws by weight; u is the first 52 bits of the MD5 of seed, learner,
    clock and item (joined by bars), so that a rerun, or SQL, gives the same. A mastered choice is redirected to a partner half of the time.
    """
    mine = last.join(contrast, ["item", "field"]).select("learner", F.col("partner").alias("item"))
    forced = mine.join(pool.select("learner", "item"), ["learner", "item"], "left_semi").groupBy("learner").agg(F.min("item").alias("forced"))
    digest = lambda *c: F.md5(F.concat_ws("|", F.lit(str(seed)), *[x.cast("string") for x in c]).cast("binary"))
    draw = lambda *c: (F.conv(F.substring(digest(*c), 1, 13), 16, 10).cast("long") + 1) / float((1 << 52) + 1)
    weight = F.greatest(F.lit(FLOOR), F.lit(1.05) - F.col("mastery"))
    any_due = F.max(F.col("is_due").cast("int")).over(W.partitionBy("learner"))
    live = pool.withColumn("_any", any_due).where("is_due or _any = 0")
    best = live.groupBy("learner").agg(F.min_by(F.struct("item", "mastery", "clock"), F.struct(-F.log(draw(F.col("learner"), F.col("clock"), F.col("item"))) / weight, "item")).alias("b")).select("learner", "b.*")
    first = contrast.groupBy("item").agg(F.min_by("partner", "field").alias("partner"))
    turned = best.join(first, "item", "left").join(pool.select("learner", F.col("item").alias("partner"), F.lit(True).alias("there")), ["learner", "partner"], "left")
    redirect = (F.col("mastery") >= HIGH) & F.coalesce("there", F.lit(False)) & (draw(F.col("learner"), F.col("clock"), F.lit("turn")) < REDIRECT)
    out = turned.join(forced, "learner", "left")
    return out.select("learner", F.when(F.col("forced").isNotNull(), F.col("forced")).when(redirect, F.col("partner")).otherwise(F.col("item")).alias("item"), F.when(F.col("forced").isNotNull(), "contrast").when(redirect, "redirect").otherwise("drawn").alias("reason"))


def replay(attempts: DataFrame, items: DataFrame) -> DataFrame:
    """learner, item, mastery, attempts, repetitions, interval, ease, is_due after a whole session, for each learner and item."""
    passed = passes(attempts)
    spaced = spacing(passed)
    state = item_mastery(mastery(attempts, ["learner", "item", "parameter"]), items)
    return state.join(due(passed, spaced, items).select("learner", "item", "is_due"), ["learner", "item"]).join(spaced, ["learner", "item"], "left")


def eligible(items: DataFrame, bank: DataFrame, clips: DataFrame, key: str) -> DataFrame:
    """key, eligible, reason: items known to the bank that also have a clip."""
    b, c = bank.select(key).distinct().withColumn("_b", F.lit(True)), clips.select(key).distinct().withColumn("_c", F.lit(True))
    df = items.select(key).distinct().join(b, key, "left").join(c, key, "left")
    reason = F.when(F.col("_b").isNull(), "not in the bank").when(F.col("_c").isNull(), "no clip")
    return df.select(key, reason.isNull().alias("eligible"), reason.alias("reason"))
