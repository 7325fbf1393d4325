"""Embeddings, labels and verdicts: nearest references, attribute verdicts with support, descriptions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators.match import numbered, stratum
from seqloom.sources.package import ship

PARAMETERS = ("handshape", "major_location", "minor_location", "movement", "repeated_movement")


def encode_labels(rows: DataFrame, column: str) -> DataFrame:
    """column, code: sorted different values numbered from 0; for sequence models add 1 and keep 0 for the blank."""
    return rows.select(column).distinct().withColumn("code", F.row_number().over(W.orderBy(column)) - 1)  # classes are few


def support(attributes: DataFrame, key: str, parameters: list[str], least: int = 3) -> DataFrame:
    """parameter, value, n (different keys with that value), well (n is enough)."""
    long = attributes.unpivot([key], parameters, "parameter", "value").where("value is not null")
    return long.groupBy("parameter", "value").agg(F.countDistinct(key).alias("n")).withColumn("well", F.col("n") >= least)


def judged(attributes: DataFrame, key: str, parameters: list[str], multi: Column, least: int = 3) -> DataFrame:
    """key, parameter, value, n, judged: judged where the value is well supported and the item has just one part."""
    long = attributes.withColumn("_m", multi).unpivot([key, "_m"], parameters, "parameter", "value")
    s = support(attributes, key, parameters, least)
    return long.join(s, ["parameter", "value"], "left").select(key, "parameter", "value", F.coalesce("n", F.lit(0)).alias("n"), (~F.col("_m") & F.coalesce("well", F.lit(False))).alias("judged"))


def euclid(a: str, b: str) -> Column:
    return F.expr(f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (cast(x as double) - y) * (cast(x as double) - y)), 0.0D, (s, d) -> s + d))")


def nearest_by_label(queries: DataFrame, bank: DataFrame, block: int = 4096, others: bool = False) -> DataFrame:
    """query, label_q, label, distance: smallest distance from each query to each label's references.

    The bank is cut into blocks of a bounded number of vectors and the queries meet every block; a task multiplies matrices in
    numpy, one block against a batch of queries, and keeps one row for each query and label, so no pair of vectors is a row.
    ``others``: a query does not meet the reference with its own id; labels without another reference give no row.
    """
    ship(bank.sparkSession)
    parts = max(1, -(-bank.count() // block))
    blocks = bank.select(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("block"), "vec_id", "label", "embedding", F.lit(False).alias("ask"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("block"), "vec_id", "label", "embedding", F.lit(True).alias("ask"))

    def run(key, table):
        ask = table.column("ask").to_numpy(zero_copy_only=False).astype(bool)
        vectors = np.array(table.column("embedding").to_pylist(), float)
        labels, ids = np.array(table.column("label").to_pylist()), np.array(table.column("vec_id").to_pylist())
        known, q = vectors[~ask], vectors[ask]
        out = {"query": [], "label_q": [], "label": [], "distance": []}
        if len(known) and len(q):
            d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (known * known).sum(1)[None] - 2 * q @ known.T, 0))
            near = np.abs(d) < 1e-5  # close to 0 the expansion loses digits
            for i, j in zip(*np.nonzero(near), strict=True):
                d[i, j] = np.sqrt(((q[i] - known[j]) ** 2).sum())
            if others:
                d[ids[ask][:, None] == ids[~ask][None]] = np.inf
            for label in np.unique(labels[~ask]):
                best = d[:, labels[~ask] == label].min(axis=1)
                met = np.isfinite(best)
                out["query"] += ids[ask][met].tolist()
                out["label_q"] += labels[ask][met].tolist()
                out["label"] += [int(label)] * int(met.sum())
                out["distance"] += best[met].tolist()
        return pa.table(out, schema=pa.schema([("query", pa.int64()), ("label_q", pa.int32()), ("label", pa.int32()), ("distance", pa.float64())]))

    # queries are dealt over several groups of a block, so that a group stays small
    share = max(1, -(-queries.count() // block))
    asked = asked.withColumn("slot", F.pmod(F.xxhash64("vec_id"), F.lit(share)).cast("int"))
    blocks = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(share - 1))))
    found = blocks.unionByName(asked).groupBy("block", "slot").applyInArrow(run, "query long, label_q int, label int, distance double")
    return found.groupBy("query", "label_q", "label").agg(F.min("distance").alias("distance"))


def categorical_verdict(rows: DataFrame, logits: str, classes: list[str], target: Column, judged: Column) -> DataFrame:
    """Adds predicted (the first of the largest), confidence (softmax), correct (null where not judged)."""
    top = F.expr(f"array_max({logits})")
    names = F.array(*[F.lit(c) for c in classes])
    df = rows.withColumns({"predicted": F.get(names, (F.array_position(logits, top) - 1).cast("int")), "confidence": 1 / F.expr(f"aggregate(transform({logits}, x -> exp(cast(x as double) - array_max({logits}))), 0.0D, (a, x) -> a + x)")})
    return df.withColumn("correct", F.when(judged, F.col("predicted").eqNullSafe(target)))


def binary_verdict(rows: DataFrame, logit: str, target: Column, judged: Column) -> DataFrame:
    """Adds predicted (sigmoid above 0.5), confidence (of what is predicted), correct (null where not judged)."""
    p = 1 / (1 + F.exp(-F.col(logit).cast("double")))
    df = rows.withColumn("_p", p).withColumns({"predicted": F.col("_p") > 0.5, "confidence": F.greatest(F.col("_p"), 1 - F.col("_p"))}).drop("_p")
    return df.withColumn("correct", F.when(judged, F.col("predicted") == target))


def score_batches(rows: DataFrame, feature: str, model: bytes | Callable[[np.ndarray], np.ndarray], out: str = "scores") -> DataFrame:
    """Adds ``out`` (array of doubles): a model over batches of fixed-size features.

    ``model`` is the bytes of an ONNX file with one input (run by onnxruntime, one session for each task) or a function on matrices.
    """
    ship(rows.sparkSession)
    shipped = rows.sparkSession.sparkContext.broadcast(model) if isinstance(model, bytes) else None
    call = None if shipped else model  # a model's bytes travel only once, by the broadcast
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None if shipped else call
        if shipped:
            import onnxruntime

            session = onnxruntime.InferenceSession(shipped.value)
            entry = session.get_inputs()[0].name
            f = lambda x: session.run(None, {entry: x.astype(np.float32)})[0]
        for batch in batches:
            x = np.array(batch.column(feature).to_pylist(), float)
            y = np.asarray(f(x), float).reshape(len(x), -1) if len(x) else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y.tolist(), pa.list_(pa.float64()))], [*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{out}` array<double>")


def pool(frames: DataFrame, feature: str = "feat") -> DataFrame:
    """series, col, mean, top of each column over a series' frames."""
    long = frames.select("series", F.posexplode(feature).alias("col", "v"))
    return long.groupBy("series", "col").agg(F.avg("v").alias("mean"), F.max("v").alias("top"))


def merge_max(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def unit(v: str) -> Column:
    """The vector over its length; a zero vector stays."""
    return F.expr(f"transform({v}, x -> cast(x as double) / greatest(sqrt(aggregate({v}, 0.0D, (a, y) -> a + cast(y as double) * y)), 1e-12))")


def hard_examples(batch: DataFrame, margin: float = 0.2) -> DataFrame:
    """vec_id, positive, negative, loss: hardest same-label and other-label distances within each (bounded) batch.

    ``batch`` has batch, vec_id, label, embedding. An anchor without a second member of its label has no positive; see ``lonely``.
    """
    a, b = batch.alias("a"), batch.alias("b")
    pairs = a.join(b, (F.col("a.batch") == F.col("b.batch")) & (F.col("a.vec_id") != F.col("b.vec_id")))
    d = pairs.select(F.col("a.batch").alias("batch"), F.col("a.vec_id").alias("vec_id"), (F.col("a.label") == F.col("b.label")).alias("same"), F.greatest(F.lit(1e-6), euclid("a.embedding", "b.embedding")).alias("d"))
    g = d.groupBy("batch", "vec_id").agg(F.max(F.when(F.col("same"), F.col("d"))).alias("positive"), F.min(F.when(~F.col("same"), F.col("d"))).alias("negative"))
    return g.withColumn("loss", F.greatest(F.lit(0.0), F.col("positive") - F.col("negative") + margin))


def lonely(batch: DataFrame) -> DataFrame:
    """batch, label with fewer than two members: a reason to refuse the batch."""
    return batch.groupBy("batch", "label").agg(F.count("*").alias("n")).where("n < 2").select("batch", "label")


def pk_batches(rows: DataFrame, batches: DataFrame, p: int, k: int, seed: int) -> DataFrame:
    """batch, label, slot, vec_id: p labels for each batch and k members of each, drawn by hashes; members repeat only where a label has fewer than k.

    Labels and the members of a label are numbered once; a draw is a number that an equi-join looks up, so a batch never meets all
    labels or all members of one. More labels than there are is refused.
    """
    labels = rows.groupBy("label").agg(F.count("*").alias("size"))
    n = labels.count()
    if n < p:
        raise ValueError(f"{p} labels for each batch, but there are {n}")
    labels = numbered(labels.withColumn("_all", F.lit(1)).drop("size"), ["_all"], "label", seed).select("label", "number").join(labels, "label")
    place = F.col("_place")
    drawn = batches.withColumn("_place", F.explode(F.expr(f"sequence(0, {p - 1})"))).withColumn("number", stratum(place, p, F.lit(n), F.xxhash64(F.lit(seed), "batch", place)))
    drawn = drawn.join(labels, "number").select("batch", "label", "size", F.explode(F.expr(f"sequence(0, {k - 1})")).alias("slot"))
    draw = F.when(F.col("size") >= k, stratum(F.col("slot"), k, F.greatest("size", F.lit(k)), F.xxhash64(F.lit(seed), "batch", "label", "slot"))).otherwise(F.col("slot") % F.col("size"))
    members = numbered(rows.select("label", "vec_id"), ["label"], "vec_id", seed).select("label", "vec_id", "number")
    return drawn.withColumn("number", draw).join(members, ["label", "number"]).select("batch", "label", "slot", "vec_id")


def majority_profile(rows: DataFrame, code: str, fields: list[str]) -> DataFrame:
    """code, profile (fields joined by "/"), n: the most frequent combination, the first in order on ties; null fields don't count."""
    t = rows.dropna(subset=fields).select(code, F.concat_ws("/", *[F.col(f).cast("string") for f in fields]).alias("profile"))
    g = t.groupBy(code, "profile").agg(F.count("*").alias("n"))
    return g.withColumn("_r", F.row_number().over(W.partitionBy(code).orderBy(F.desc("n"), "profile"))).where("_r = 1").select(code, "profile", "n")


def readable(parameter: Column, value: Column) -> Column:
    """A label code in words: underscores and camel case become spaces, words of one or two letters upper case, others capitalised."""
    spaced = F.regexp_replace(F.replace(value, F.lit("_"), F.lit(" ")), "(?<=[a-z0-9])(?=[A-Z])", " ")
    words = F.filter(F.split(spaced, r"\s+"), lambda w: w != "")
    cased = F.transform(words, lambda w: F.when(F.length(w) <= 2, F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))))
    said = F.when(value == "True", "repeats").when(value == "False", "does not repeat").otherwise(value)
    return F.when(parameter == "repeated_movement", said).otherwise(F.array_join(cased, " "))


def focus(verdicts: DataFrame) -> DataFrame:
    """attempt, judged, wrong, focus (the wrong parameter of the highest confidence, the first in order on ties), others.

    ``verdicts`` has attempt, parameter, predicted, target, correct, confidence.
    """
    order = F.array_position(F.array(*[F.lit(p) for p in PARAMETERS]), F.col("parameter"))
    wrong = ~F.col("correct")
    row = F.struct((-F.col("confidence")).alias("c"), order.alias("o"), "parameter", "predicted", "target")
    g = verdicts.groupBy("attempt").agg(F.count("correct").alias("judged"), F.count_if(wrong).alias("wrong"), F.sort_array(F.collect_list(F.when(wrong, row))).alias("w"))
    rest = F.expr("transform(sort_array(transform(slice(w, 2, 100), x -> struct(x.o as o, x.parameter as p))), x -> x.p)")
    return g.select("attempt", "judged", "wrong", F.get("w", F.lit(0))["parameter"].alias("focus"), F.get("w", F.lit(0))["predicted"].alias("predicted"), F.get("w", F.lit(0))["target"].alias("target"), rest.alias("others"))


def coach(verdicts: DataFrame, names: dict[str, str], tips: dict[str, str]) -> DataFrame:
    """attempt, message: praise, a note that nothing was judged, or one correction with what else was off."""
    f = focus(verdicts)
    lookup = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    name, tip = F.element_at(lookup(names), F.col("focus")), F.element_at(lookup(tips), F.col("focus"))
    also = F.when(F.size("others") > 0, F.concat(F.lit(" Not yet right: "), F.array_join(F.transform("others", lambda p: F.element_at(lookup(names), p)), ", "), F.lit("."))).otherwise("")
    text = F.concat(F.lit("Work on "), name, F.lit(": seen "), readable(F.col("focus"), F.col("predicted")), F.lit(", wanted "), readable(F.col("focus"), F.col("target")), F.lit(". "), tip, F.lit("."), also)
    return f.select("attempt", F.when(F.col("judged") == 0, "Nothing was judged part by part.").when(F.col("wrong") == 0, "Everything judged matched.").otherwise(text).alias("message"))


def facts(verdicts: DataFrame) -> DataFrame:
    """attempt, wrong, right (names joined by commas), all_correct (false if nothing is judged)."""
    pick = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("parameter")))), ",")
    g = verdicts.groupBy("attempt").agg(pick(~F.col("correct")).alias("wrong"), pick(F.col("correct")).alias("right"), F.count("correct").alias("_j"))
    return g.select("attempt", "wrong", "right", ((F.col("_j") > 0) & (F.col("wrong") == "")).alias("all_correct"))


def describe(rows: DataFrame, key: str, shape: str, place: str, motion: str, repeats: Column, multi: Column) -> DataFrame:
    """key, description: two plain sentences from an item's attributes."""
    label = readable(F.lit(""), F.col(shape))
    article = F.when(F.substring(label, 1, 1).isin(*"AEIOU"), "an ").otherwise("a ")
    where = F.when(F.col(place) == "Neutral", "in front of the body").otherwise(F.concat(F.lit("at the "), F.lower(readable(F.lit(""), F.col(place)))))
    head = F.when(multi, "The first part has ").otherwise("It has ")
    moves = F.when(F.col(motion) == "None", F.when(repeats, "It stays in place with a small repeated motion.").otherwise("It stays in place.")).otherwise(F.concat(F.lit("It makes a "), F.when(repeats, "repeated ").otherwise("single "), F.lower(readable(F.lit(""), F.col(motion))), F.lit(" movement.")))
    return rows.select(key, F.concat(head, article, label, F.lit(" shape "), where, F.lit(". "), moves).alias("description"))
