"""Evaluation roll-ups over rank, distance and verdict tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(ranks: DataFrame, k: int = 5) -> DataFrame:
    """One row: n, top1, topk, chance; ``ranks`` has query, label_q, label, rank."""
    own = ranks.where("label = label_q").select("query", "rank")
    per = ranks.groupBy("query").agg(F.count("*").alias("labels")).join(own, "query", "left")
    return per.agg(F.count("*").alias("n"), F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("top1"), F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias("topk"), F.avg(1 / F.col("labels")).alias("chance"))


def class_accuracy(predictions: DataFrame) -> DataFrame:
    """label_q, n, accuracy, confused (its most frequent wrong prediction, the smaller on ties); ``predictions`` has label_q, label."""
    g = predictions.groupBy("label_q", "label").agg(F.count("*").alias("k"))
    worst = F.max(F.when(F.col("label") != F.col("label_q"), F.struct("k", (-F.col("label")).alias("m"))))
    out = g.groupBy("label_q").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("label") == F.col("label_q"), F.col("k")).otherwise(0)).alias("right"), worst.alias("w"))
    return out.select("label_q", "n", (F.col("right") / F.col("n")).alias("accuracy"), (-F.col("w.m")).alias("confused"))


def pair_separation(distances: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, closer_a, closer_b, separated: share of each member's queries that are nearer to the other; separated if both are at most half."""
    d = distances.select("query", "label_q", "label", "distance")
    own = d.where("label = label_q").select("query", F.col("label_q").alias("x"), F.col("distance").alias("mine"))
    sides = pairs.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("s")).select("a", "b", "s.*")
    met = sides.join(own, "x").join(d.select("query", F.col("label").alias("y"), F.col("distance").alias("other")), ["query", "y"])
    share = lambda side: F.avg(F.when(F.col("x") == F.col(side), F.when(F.col("other") < F.col("mine"), 1.0).otherwise(0.0)))
    g = met.groupBy("a", "b").agg(share("a").alias("closer_a"), share("b").alias("closer_b"), F.count("*").alias("n"), F.count_if(F.col("other") < F.col("mine")).alias("confused"))
    return g.withColumn("separated", (F.coalesce("closer_a", F.lit(0.0)) <= 0.5) & (F.coalesce("closer_b", F.lit(0.0)) <= 0.5))


def by_parameter(confusion: DataFrame, small: int = 4) -> DataFrame:
    """source, parameter, pairs, confused, n, rate, small_n: pair confusions rolled up; ``confusion`` has source, parameter, confused, n."""
    g = confusion.groupBy("source", "parameter").agg(F.count("*").alias("pairs"), F.sum("confused").alias("confused"), F.sum("n").alias("n"))
    return g.withColumns({"rate": F.col("confused") / F.col("n"), "small_n": F.col("pairs") < small})


def agreement(rates: DataFrame) -> DataFrame:
    """source, hardest, agreed: the parameter with the highest rate for each source (the larger name on ties), and whether all sources name one."""
    hardest = rates.groupBy("source").agg(F.max(F.struct("rate", "parameter"))["parameter"].alias("hardest"))
    one = hardest.agg((F.countDistinct("hardest") == 1).alias("agreed"))
    return hardest.join(F.broadcast(one))


def in_bank(pairs: DataFrame, bank: DataFrame, key: str) -> DataFrame:
    """Pairs (a, b) both of whose members are in the bank."""
    have = bank.select(key).distinct()
    return pairs.join(have.withColumnRenamed(key, "a"), "a", "left_semi").join(have.withColumnRenamed(key, "b"), "b", "left_semi")


def verdict_tally(verdicts: DataFrame, well: Column) -> DataFrame:
    """parameter, n, judged, well, right, accuracy (of judged verdicts); ``verdicts`` has parameter, correct (null: not judged)."""
    g = verdicts.groupBy("parameter").agg(F.count("*").alias("n"), F.count("correct").alias("judged"), F.count_if(well).alias("well"), F.count_if(F.col("correct")).alias("right"))
    return g.withColumn("accuracy", F.try_divide("right", "judged"))


def boundary_error(segments: DataFrame, limit: float = 0.5) -> DataFrame:
    """One row: n, mean, median, abs_mean, worst, over: errors of predicted lengths over true ones; a true length of 0 counts 1."""
    e = segments.select(F.abs(F.col("predicted") - F.col("true")).alias("a"), F.when(F.col("true") == 0, 1.0).otherwise(F.abs(F.col("predicted") - F.col("true")) / F.col("true")).alias("e"))
    return e.agg(F.count("*").alias("n"), F.avg("e").alias("mean"), F.percentile("e", F.lit(0.5)).alias("median"), F.avg("a").alias("abs_mean"), F.max("e").alias("worst"), F.count_if(F.col("e") > limit).alias("over"))


def verdict_agreement(one: DataFrame, two: DataFrame) -> DataFrame:
    """parameter, n, same_verdict, same_label over attempts that the first table judges; both have attempt, parameter, correct, predicted."""
    b = two.select("attempt", "parameter", F.col("correct").alias("c2"), F.col("predicted").alias("p2"))
    both = one.where("correct is not null").join(b, ["attempt", "parameter"])
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return both.groupBy("parameter").agg(F.count("*").alias("n"), share(F.col("correct").eqNullSafe(F.col("c2"))).alias("same_verdict"), share(F.col("predicted").eqNullSafe(F.col("p2"))).alias("same_label"))


def generalisation_gap(history: DataFrame) -> DataFrame:
    """run, best_epoch (the first of the best validation), best_val, gap (train less validation there), last_gain."""
    h = history.withColumn("gain", F.col("val") - F.lag("val").over(W.partitionBy("run").orderBy("epoch")))
    g = h.groupBy("run").agg(F.max(F.struct("val", (-F.col("epoch")).alias("e"), "train")).alias("b"), F.max(F.struct("epoch", "gain"))["gain"].alias("last_gain"))
    return g.select("run", (-F.col("b.e")).alias("best_epoch"), F.col("b.val").alias("best_val"), (F.col("b.train") - F.col("b.val")).alias("gap"), "last_gain")


def value_at(rows: DataFrame, column: str, rank: int, bins: int = 1024) -> float:
    """The value of ``column`` at a rank (from 0) in order: counts of bins, then of bins inside the bin that holds the rank, and so on.

    Each round is an aggregate of at most ``bins`` rows, and ends at the latest when a bin is one value, so nothing is sorted.
    """
    x = F.col(column).cast("double")
    low, high = rows.agg(F.min(x), F.max(x)).first()
    while low < high:
        size = (high - low) / bins
        own = F.least(F.floor((x - F.lit(low)) / F.lit(size)), F.lit(bins - 1))
        found = rows.where((x >= F.lit(low)) & (x <= F.lit(high))).groupBy(own.alias("bin")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).collect()
        for r in sorted(found, key=lambda r: r["bin"]):
            if rank < r["n"]:
                low, high = r["low"], r["high"]
                break
            rank -= r["n"]
    return low


def funnel(rows: DataFrame, tries: int = 6) -> DataFrame:
    """One row: n, accepted, on_target, shown, latency_median, latency_p90 (at index int(0.9 (n - 1))), within (mean chance to show within so many tries), never (signs never shown).

    ``rows`` has sign, in_scope, has_target, good, latency.
    """
    shown = F.col("in_scope") & F.col("has_target") & F.col("good")
    marked = rows.withColumn("shown", shown)
    per = marked.groupBy("sign").agg(F.avg(F.col("shown").cast("double")).alias("p"))
    per = per.agg(F.avg(1 - F.pow(1 - F.col("p"), F.lit(tries))).alias("within"), F.count_if(F.col("p") == 0).alias("never"))
    total = marked.agg(F.count("*").alias("n"), F.count_if("in_scope").alias("accepted"), F.count_if(F.col("in_scope") & F.col("has_target")).alias("on_target"), F.count_if("shown").alias("shown"), F.percentile("latency", F.lit(0.5)).alias("latency_median"))
    n = rows.where("latency is not null").count()
    p90 = value_at(rows, "latency", int(0.9 * (n - 1))) if n else None
    return total.join(F.broadcast(per)).withColumn("latency_p90", F.lit(p90).cast("double"))  # one row each


def parity(one: DataFrame, two: DataFrame) -> DataFrame:
    """parameter, n, changed, match_rate, mean_gap, p95_gap between two runs of (attempt, parameter, predicted, x, y)."""
    b = two.select("attempt", "parameter", F.col("predicted").alias("p2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    both = one.join(b, ["attempt", "parameter"]).withColumn("gap", F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")))
    changed = ~F.col("predicted").eqNullSafe(F.col("p2"))
    return both.groupBy("parameter").agg(F.count("*").alias("n"), F.count_if(changed).alias("changed"), F.avg(F.when(changed, 0.0).otherwise(1.0)).alias("match_rate"), F.avg("gap").alias("mean_gap"), F.percentile("gap", F.lit(0.95)).alias("p95_gap"))
