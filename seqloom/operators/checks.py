"""Joins, key resolution and data quality: each check is a table of what it found, empty when all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def manifest(rows: DataFrame, wanted: DataFrame, key: str, path: Column) -> DataFrame:
    """Rows whose key is wanted, with the wanted table's columns, ``video_id`` (the path's file stem) and ``video_path``."""
    return rows.join(wanted, key).withColumn("video_path", path).withColumn("video_id", F.regexp_replace("video_path", r"^.*/|\.[^.]*$", ""))


def leaks(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that stand in more than one split, with the splits joined by commas."""
    found = rows.select(group, split).distinct().groupBy(group).agg(F.count("*").alias("n_splits"), F.array_join(F.array_sort(F.collect_list(split)), ",").alias("splits"))
    return found.where("n_splits > 1")


def reconcile(rows: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key, n, expected, ok: counts against what was expected, either side may lack the key."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n"))
    both = counted.join(expected, key, "full_outer")
    return both.select(key, "n", "expected", F.col("n").eqNullSafe(F.col("expected")).alias("ok"))


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Wanted rows whose key is not present."""
    return wanted.join(present.select(key), key, "left_anti")


def completeness(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """key, status (ok, missing, orphan) for each key on either side."""
    a = wanted.select(key).distinct().withColumn("_w", F.lit(True))
    b = present.select(key).distinct().withColumn("_p", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_p").isNull(), "missing").when(F.col("_w").isNull(), "orphan").otherwise("ok").alias("status"))


def problems(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """keys, problems: the names of all rules that a row breaks (their columns are true or null), joined by "; "."""
    said = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return rows.select(*keys, F.array_join(said, "; ").alias("problems")).where("problems <> ''")


def drift(rows: DataFrame, expected: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows with status (unknown where no expectation stands, stale, ok) and the fields that differ from what is expected."""
    want = expected.select(key, F.lit(True).alias("_known"), *[F.col(f).alias(f"_{f}") for f in fields])
    df = rows.join(want, key, "left")
    differ = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]))
    df = df.withColumn("mismatches", F.when(F.col("_known"), F.array_join(differ, ",")).otherwise(""))
    status = F.when(F.col("_known").isNull(), "unknown").when(F.col("mismatches") != "", "stale").otherwise("ok")
    return df.withColumn("status", status).drop("_known", *[f"_{f}" for f in fields])


def roll_up(rows: DataFrame, by: str, status: str, names: list[str]) -> DataFrame:
    """by, one count for each status, ok (no row has any status but the first)."""
    g = rows.groupBy(by).agg(*[F.count_if(F.col(status) == n).alias(n) for n in names])
    return g.withColumn("ok", sum((F.col(n) for n in names[1:]), F.lit(0)) == 0)


def attribute_join(keys: DataFrame, attributes: DataFrame, key: str, wanted: list[str]) -> tuple[DataFrame, list[str], DataFrame]:
    """Keys with those wanted columns that exist; the wanted columns that don't; the keys without a row."""
    there = [c for c in wanted if c in attributes.columns]
    joined = keys.join(attributes.select(key, *there), key, "left")
    return joined, [c for c in wanted if c not in there], missing(keys, attributes, key)


def truthy(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes", "y", "t")


def multi_part(count: Column, compound: Column) -> Column:
    """More than one part by a count that may not be a number, or marked as compound."""
    return F.coalesce(count.try_cast("double").cast("int") > 1, F.lit(False)) | F.coalesce(truthy(compound), F.lit(False))


def resolve(entries: DataFrame, present: DataFrame, uses: DataFrame) -> DataFrame:
    """entry, code, name, error: entries (entry, code) with one code that is present (code); name is the code's most used (code, name).

    Several codes, or one that is not present, give an error instead; of equally used names the first in order is taken.
    """
    one = entries.groupBy("entry").agg(F.countDistinct("code").alias("n"), F.min("code").alias("code"))
    ranked = uses.groupBy("code", "name").agg(F.count("*").alias("k")).withColumn("r", F.row_number().over(W.partitionBy("code").orderBy(F.desc("k"), "name"))).where("r = 1")
    df = one.join(present.select("code").distinct().withColumn("_there", F.lit(True)), "code", "left").join(ranked.select("code", "name"), "code", "left")
    error = F.when(F.col("n") > 1, "several codes").when(F.col("_there").isNull(), "code not present")
    return df.select("entry", F.when(error.isNull(), F.col("code")).alias("code"), F.when(error.isNull(), F.col("name")).alias("name"), error.alias("error"))


def resolve_variants(bases: DataFrame, names: DataFrame, most_unknown: float = 0.10) -> DataFrame:
    """base, name, n_candidates, candidates, error: the most frequent name ``BASE<digits>`` whose unknown share is small enough.

    ``names`` has name, frequency (may be null), unknown (may be null). Candidates are ranked by frequency, nulls last. The join
    is on the name without its digits and finds each base once.
    """
    cands = names.withColumn("base", F.regexp_replace("name", r"\d*$", ""))
    both = bases.select(F.upper("base").alias("base")).join(cands, "base", "left")
    eligible = F.coalesce(F.col("unknown") <= most_unknown, F.lit(False))
    g = both.groupBy("base").agg(
        F.count("name").alias("n_candidates"),
        F.sort_array(F.collect_list(F.when(F.col("name").isNotNull(), F.struct(F.col("frequency").isNull().alias("none"), (-F.coalesce("frequency", F.lit(0.0))).alias("f"), "name", eligible.alias("eligible"))))).alias("c"),
    )
    first = F.filter("c", lambda x: x["eligible"])
    error = F.when(F.col("n_candidates") == 0, "no variant").when(F.size(first) == 0, "none eligible")
    return g.select("base", F.when(F.size(first) > 0, F.get(first, F.lit(0))["name"]).alias("name"), "n_candidates", F.array_join(F.transform("c", lambda x: x["name"]), ",").alias("candidates"), error.alias("error"))


def confirmed(resolved: DataFrame) -> DataFrame:
    """One row: n, resolved, distinct_codes, confirmed (all resolved, to different codes)."""
    g = resolved.agg(F.count("*").alias("n"), F.count("code").alias("resolved"), F.countDistinct("code").alias("distinct_codes"))
    return g.withColumn("confirmed", (F.col("n") == F.col("resolved")) & (F.col("n") == F.col("distinct_codes")))


def violations(checks: dict[str, DataFrame], detail: str = "detail") -> DataFrame:
    """rule, detail: the findings of all checks (one string column each) in one table."""
    parts = [df.select(F.lit(name).alias("rule"), F.col(df.columns[0]).cast("string").alias(detail)) for name, df in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stale_aggregates(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """key, stored, actual of keys whose stored count (key, n) isn't the actual one."""
    actual = rows.groupBy(key).agg(F.count("*").alias("actual"))
    both = stored.select(key, F.col("n").alias("stored")).join(actual, key, "full_outer")
    return both.where("not (stored <=> actual)")


def differing(fields: list[str], left: str, right: str) -> Column:
    """Names of the fields in which two aliased rows differ."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")), F.lit(f)) for f in fields]))


#: Rows of a group whose pairs are made together.
BLOCK = 256


def _held_apart(rows: DataFrame, key: str, fields: list[str], exempt: dict[str, str] | None) -> tuple[DataFrame, list[str]]:
    """A row for each row and field: field, key, the field's value (in a struct, so that null is a value) and the rest, which rows that differ in this field only have in common."""
    parts = []
    for f in fields:
        same = [g for g in fields if g not in (f, (exempt or {}).get(f))]
        rest = [F.when(F.lit(g in same), F.col(g)).alias(f"_{g}") for g in fields]
        value = F.struct(*[F.when(F.lit(g == f), F.col(g)).alias(g) for g in fields])
        parts.append(F.struct(F.lit(f).alias("field"), F.col(key).alias("_key"), value.alias("_value"), *rest))
    apart = rows.where(F.col(key).isNotNull()).select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    return apart, ["field", *[f"_{g}" for g in fields]]


def minimal_pairs(rows: DataFrame, key: str, fields: list[str], exempt: dict[str, str] | None = None) -> DataFrame:
    """a, b, field: pairs (a < b) that differ in just one field. ``exempt`` names, for a field, another whose difference doesn't count.

    Two such rows agree on all fields but one. So for each field the rows are grouped by the rest and cut into blocks, sorted by the field's value; pairs of blocks are dealt out
    evenly, whatever the sizes of the groups, and pairs of rows exist only inside a task. Blocks of one and the same value never meet.
    """
    apart, group = _held_apart(rows, key, fields, exempt)
    in_order = W.partitionBy(*group)
    numbered = apart.withColumn("_n", F.row_number().over(in_order.orderBy("_value", "_key"))).withColumn("_v", F.dense_rank().over(in_order.orderBy("_value")))
    blocks = numbered.groupBy(*group, F.expr(f"(_n - 1) div {BLOCK}").alias("_b")).agg(F.collect_list(F.struct("_key", "_v")).alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    # of one plan, so that it is made once; merged, as neither side is a small table
    x, y = blocks.alias("x"), blocks.alias("y").hint("merge")
    on = (F.col("x._b") <= F.col("y._b")) & ~((F.col("x._low") == F.col("y._high")) & (F.col("x._high") == F.col("y._low")))
    for g in group:
        on = on & F.col(f"x.{g}").eqNullSafe(F.col(f"y.{g}"))
    one = F.col("x._b") == F.col("y._b")
    met = x.join(y, on).select(*[F.col(f"x.{g}") for g in group], F.col("x._b").alias("_i"), F.col("y._b").alias("_j"), one.alias("_one"), F.col("x._rows").alias("_x"), F.col("y._rows").alias("_y")).repartition(*group, "_i", "_j")
    pairs = met.select("field", "_one", F.explode("_x").alias("x"), "_y").select("field", "_one", F.col("x._key").alias("x"), F.col("x._v").alias("v"), F.explode("_y").alias("y"))
    # in a block each pair is met from both sides
    found = pairs.where((F.col("v") != F.col("y._v")) & (F.col("x") != F.col("y._key")) & (~F.col("_one") | (F.col("x") < F.col("y._key"))))
    return found.select(F.least("x", "y._key").alias("a"), F.greatest("x", "y._key").alias("b"), "field")


def first_partners(rows: DataFrame, key: str, fields: list[str], exempt: dict[str, str] | None = None) -> DataFrame:
    """item, field, partner: of each row's minimal pairs in a field, in either direction, the first in order of (a, b), without making the pairs.

    That is the smallest other key with another value among the rows that share the rest. At most four keys of a group can be it for any row: the smallest of two values,
    and two that stand there with several values.
    """
    apart, group = _held_apart(rows, key, fields, exempt)
    once = apart.groupBy(*group, "_key").agg(F.min("_value").alias("_value"), F.max("_value").alias("_most"))
    tagged = once.select(*group, "_key", F.when(F.col("_value") == F.col("_most"), F.col("_value")).alias("_only"))
    least = tagged.withColumn("_r", F.row_number().over(W.partitionBy(*group, "_only").orderBy("_key"))).where((F.col("_r") == 1) | (F.col("_only").isNull() & (F.col("_r") == 2)))
    few = least.withColumn("_r", F.row_number().over(W.partitionBy(*group, F.col("_only").isNull()).orderBy("_key"))).where("_r <= 2")
    candidates = few.groupBy(*group).agg(F.collect_list(F.struct("_key", "_only")).alias("_c"))
    y = candidates.select(*[F.col(g).alias(f"y{g}") for g in group], "_c").hint("merge")
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"y{g}"))
    fit = F.filter("_c", lambda c: (c["_key"] != F.col("_key")) & ~c["_only"].eqNullSafe(F.col("_value")))
    met = apart.join(y, on).select(F.col("_key").alias("item"), "field", F.array_min(F.transform(fit, lambda c: c["_key"])).alias("partner"))
    return met.where("partner is not null").groupBy("item", "field").agg(F.min("partner").alias("partner"))


def unknown_tokens(texts: DataFrame, text: Column, pattern: str, known: DataFrame, key: str) -> DataFrame:
    """token, n: tokens of the texts by a pattern that are no known key."""
    tokens = texts.select(F.explode(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)).alias(key))
    return tokens.groupBy(key).agg(F.count("*").alias("n")).join(known.select(key), key, "left_anti")


def ambiguous(lexicon: DataFrame, word: str, target: str) -> DataFrame:
    """word, targets: words that more than one target claims; a build should stop where this is not empty."""
    g = lexicon.select(word, target).distinct().groupBy(word).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(target)), ",").alias("targets"))
    return g.where("n > 1").select(word, "targets")


def outside(subset: DataFrame, whole: DataFrame) -> DataFrame:
    """Rows of the first table that the second lacks; empty means that it is a subset."""
    return subset.subtract(whole.select(*subset.columns))


def class_drift(stored: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """position, stored, current where two ordered class lists differ."""
    number = lambda df, name: df.select(F.col(column).alias(name)).distinct().withColumn("position", F.row_number().over(W.orderBy(name)))  # noqa: E731  class lists are small
    return number(stored, "stored").join(number(current, "current"), "position", "full_outer").where("not (stored <=> current)").select("position", "stored", "current")


def partition_faults(points: DataFrame, regions: DataFrame) -> DataFrame:
    """idx, n: points that no region or more than one region covers."""
    g = regions.groupBy("idx").agg(F.count("*").alias("n"))
    return points.join(g, "idx", "left").select("idx", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def clip_problems(clips: DataFrame, points: dict[str, int], extras: dict[str, int]) -> DataFrame:
    """clip, problems (all that were found, joined by "; ", empty for a healthy clip) of stored clips, as expressions over their nested arrays.

    ``clips`` has clip, backend, tag, keypoints (frames of points of coordinates), scores (frames of numbers) and extra (frames of numbers); ``points`` says how many points a
    backend has, ``extras`` which backends must have extra numbers, and how many. A null array is missing; a clip without keypoints or scores has no other problem named.
    """
    lookup = lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col("backend"))
    df = clips.withColumns({"_points": lookup(points), "_extra": lookup(extras)})
    bad = "x -> x is null or isnan(x) or abs(x) = double('inf')"
    rules = {
        "points without two coordinates": "exists(keypoints, f -> exists(f, p -> size(p) <> 2))",
        "no frames": "size(keypoints) = 0",
        "keypoints and scores differ in frames": "size(keypoints) <> size(scores)",
        "wrong number of points": "_points is null or exists(keypoints, f -> size(f) <> _points) or exists(scores, f -> size(f) <> _points)",
        "keypoints not finite": f"exists(keypoints, f -> exists(f, p -> exists(p, {bad})))",
        "scores not finite": f"exists(scores, f -> exists(f, {bad}))",
        "extra missing": "_extra is not null and extra is null",
        "extra of the wrong shape": "_extra is not null and (size(extra) <> size(keypoints) or exists(extra, f -> size(f) <> _extra))",
        "extra not finite": f"_extra is not null and exists(extra, f -> exists(f, {bad}))",
        "tag of another backend": "tag is not null and tag <> backend",
    }
    found = F.array_join(F.array_compact(F.array(*[F.when(F.expr(c), text) for text, c in rules.items()])), "; ")
    return df.select("clip", F.when(F.expr("keypoints is null or scores is null"), "missing arrays").otherwise(found).alias("problems"))
