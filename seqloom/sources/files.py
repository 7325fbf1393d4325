"""Sources and sinks: text tables in unknown encodings, header aliases, nested vocabularies, binary clips, attempt logs, indexes."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.sources.package import ship

#: Tried in this order; the last one reads any bytes.
ENCODINGS = ("utf-8", "windows-1252", "iso-8859-1")
#: Bytes that windows-1252 leaves undefined, and the characters that latin-1 and windows-1252 make of the bytes in which they differ.
_UNDEFINED = "\x81\x8d\x8f\x90\x9d"
LATIN_1 = "".join(chr(b) for b in range(0x80, 0xA0) if chr(b) not in _UNDEFINED)
WINDOWS = LATIN_1.encode("latin-1").decode("cp1252")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path, url, length of all files below ``path`` that are not empty; no file is opened."""
    return spark.read.option("recursiveFileLookup", True).format("binaryFile").load(path).select("path", F.col("_metadata.file_path").alias("url"), "length")


def encodings(spark: SparkSession, path: str) -> DataFrame:
    """path, encoding of each file that is not empty: UTF-8 where its bytes are valid, else windows-1252 where they are defined, else latin-1.

    Lines are judged where they lie, and a file by its lines: a line break is never part of a longer UTF-8 character. So a file of any size is read in splits.
    """
    line = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("url"), "value")
    odd = F.decode(F.col("value").cast("binary"), "iso-8859-1").rlike(f"[{_UNDEFINED}]")
    judged = line.groupBy("url").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(odd).alias("odd"))
    encoding = F.when(F.coalesce("utf8", F.lit(True)), ENCODINGS[0]).when(~F.col("odd"), ENCODINGS[1]).otherwise(ENCODINGS[2])
    return listed(spark, path).join(judged, "url", "left").select("path", encoding.alias("encoding"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files with a header under ``path``, each in its own encoding; a byte order mark in front of the header is dropped.

    Files are grouped by encoding, so there are at most three reads; columns are strings.
    """
    out = None
    for row in encodings(spark, path).groupBy("encoding").agg(F.collect_list("path").alias("paths")).collect():  # file names, not data
        windows = row["encoding"] == "windows-1252"  # Spark has no reader for it: it is latin-1 with other characters in one range
        df = spark.read.option("header", True).option("encoding", "iso-8859-1" if windows else row["encoding"]).csv(row["paths"])
        if windows:
            df = df.select([F.translate(F.col(f"`{c}`"), LATIN_1, WINDOWS).alias(c.translate(str.maketrans(LATIN_1, WINDOWS))) for c in df.columns])
        df = df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(path)
    return out


def resolve_columns(columns: list[str], wanted: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """wanted name to column, by aliases without regard to case: equal first, then containing, then starting with; KeyError if none fits."""
    low = {c.strip().lower(): c for c in reversed(columns)}
    out = {}
    for name, aliases in wanted.items():
        tests = [lambda c, a: c == a, lambda c, a: a in c, lambda c, a: c.startswith(a)]
        hit = next((low[c] for test in tests for a in aliases for c in map(str.lower, map(str.strip, columns)) if test(c, a.lower())), None)
        if hit is None:
            raise KeyError(f"no column for {name} among {', '.join(columns)}")
        out[name] = hit
    return out


def select_aliases(df: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """The wanted columns under their own names; fails before any job if one is missing."""
    found = resolve_columns(df.columns, wanted)
    return df.select([F.col(f"`{c}`").alias(name) for name, c in found.items()])


def headers(spark: SparkSession, path: str) -> DataFrame:
    """path, header (array of names) of each text file: only first lines are kept."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("n"))
    first = lines.where("at = 0").groupBy("path").agg(F.min_by("value", "n").alias("value"))
    return first.select("path", F.transform(F.split(F.regexp_replace("value", "^\ufeff", ""), ","), lambda c: F.lower(F.trim(c))).alias("header"))


def choose_table(found: DataFrame, needed: list[str]) -> DataFrame:
    """path, complete: the first file with all needed names, else the files that have some, to be joined by their key."""
    need = F.array(*[F.lit(n.lower()) for n in needed])
    df = found.withColumn("k", F.size(F.array_intersect("header", need))).where("k > 0").withColumn("complete", F.col("k") == len(needed))
    best = df.where("complete").orderBy("path").limit(1)
    return best.select("path", "complete").union(df.join(best.select(F.lit(True).alias("_b")), how="left_anti").select("path", "complete"))


def flatten_units(units: DataFrame) -> DataFrame:
    """unit, place and the sign's fields of a nested vocabulary: units with id and signs (array of structs)."""
    return units.select(F.col("id").alias("unit"), F.posexplode("signs").alias("place", "sign")).select("unit", "place", "sign.*")


CLIP = "series long, t int, kp array<struct<x: double, y: double>>, score array<double>, extra array<double>"


def encode_clips(clips: DataFrame) -> DataFrame:
    """series, content: each clip's arrays (kp: frames of points, score, optional extra) as the bytes of a compressed array file."""
    ship(clips.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                arrays = {"keypoints": np.array([[[p["x"], p["y"]] for p in f] for f in row["kp"]]), "scores": np.array(row["score"])}
                if row["extra"] is not None:
                    arrays["extra"] = np.array(row["extra"])
                np.savez_compressed(buffer := io.BytesIO(), **arrays)
                out.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column("series").cast(pa.int64()), pa.array(out, pa.binary())], ["series", "content"])

    return clips.select(F.col("series").cast("long").alias("series"), "kp", "score", "extra").mapInArrow(run, "series long, content binary")


def decode_clips(files: DataFrame) -> DataFrame:
    """Frames (see ``CLIP``) of array files; ``extra`` is null where a file has none. One file is held at a time."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("series", pa.int64()), ("t", pa.int32()), ("kp", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("score", pa.list_(pa.float64())), ("extra", pa.list_(pa.float64()))])
        for batch in batches:
            for row in batch.to_pylist():
                with np.load(io.BytesIO(row["content"]), allow_pickle=False) as f:
                    kp, score, extra = f["keypoints"], f["scores"], f["extra"] if "extra" in f.files else None
                n = len(kp)
                yield pa.RecordBatch.from_arrays([pa.array([row["series"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([[{"x": x, "y": y} for x, y in frame] for frame in kp.tolist()], schema.field("kp").type), pa.array(score.tolist(), schema.field("score").type), pa.array([None] * n if extra is None else extra.tolist(), schema.field("extra").type)], schema=schema)

    return files.select(F.col("series").cast("long").alias("series"), "content").mapInArrow(run, CLIP)


def index_scan(manifest: DataFrame, attributes: DataFrame, key: str, split: str | None = None) -> DataFrame:
    """The manifest (of one split) with its attributes, without opening a clip; null where a key has none."""
    rows = manifest.where(F.col("split") == split) if split else manifest
    return rows.join(attributes, key, "left")


def to_do(wanted: DataFrame, done: DataFrame, key: str, force: bool = False, limit: int | None = None) -> DataFrame:
    """Wanted rows that are not done yet (all, if forced), at most ``limit`` in order of the key."""
    rows = wanted if force else wanted.join(done.select(key), key, "left_anti")
    return rows.orderBy(key).limit(limit) if limit is not None else rows


FORMAT = "attempt/1"
ATTEMPT = "attempt string, t int, time double, state int, kp array<struct<x: float, y: float>>, score array<float>"


def pack_attempt(times: list[float], kp: list, score: list, state: list[int]) -> bytes:
    """Little-endian f64 times, f32 keypoints, f32 scores, i8 states, one block after the other."""
    return b"".join((np.array(times, "<f8").tobytes(), np.array(kp, "<f4").tobytes(), np.array(score, "<f4").tobytes(), np.array(state, "i1").tobytes()))


def unpack_attempt(content: bytes, meta: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, k = int(meta["n_frames"]), int(meta["n_keypoints"])
    if meta.get("format") != FORMAT:
        raise ValueError(f"unknown format {meta.get('format')!r}")
    sizes = (8 * n, 8 * n * k, 4 * n * k, n)
    if len(content) != sum(sizes):
        raise ValueError(f"{len(content)} bytes instead of {sum(sizes)} for {n} frames of {k} points")
    at = np.cumsum((0, *sizes))
    part = [content[a:b] for a, b in zip(at, at[1:], strict=False)]
    return np.frombuffer(part[0], "<f8"), np.frombuffer(part[1], "<f4").reshape(n, k, 2), np.frombuffer(part[2], "<f4").reshape(n, k), np.frombuffer(part[3], "i1")


def decode_attempts(blobs: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Frames (see ``ATTEMPT``) of ``blobs`` (attempt, content, meta: JSON); attempts that are done already are left out."""
    ship(blobs.sparkSession)
    rows = blobs if done is None else blobs.join(done.select("attempt").distinct(), "attempt", "left_anti")
    kinds = [pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.struct([("x", pa.float32()), ("y", pa.float32())])), pa.list_(pa.float32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist()):
                times, kp, score, state = unpack_attempt(row["content"], json.loads(row["meta"]))
                n, k = score.shape
                # lists by their offsets: no object for each point
                at = pa.array(np.arange(n + 1, dtype=np.int32) * k)
                point = pa.StructArray.from_arrays([pa.array(kp[:, :, c].reshape(-1), pa.float32()) for c in (0, 1)], ["x", "y"])
                lists = [pa.ListArray.from_arrays(at, x) for x in (point, pa.array(score.reshape(-1), pa.float32()))]
                data = [pa.repeat(row["attempt"], n), pa.array(np.arange(n, dtype=np.int32)), pa.array(times), pa.array(state.astype(np.int32)), *lists]
                yield pa.RecordBatch.from_arrays([d.cast(k) for d, k in zip(data, kinds, strict=True)], ["attempt", "t", "time", "state", "kp", "score"])

    return rows.select("attempt", "content", "meta").mapInArrow(run, ATTEMPT)


def write_attempts(frames: DataFrame, meta: DataFrame, path: str) -> None:
    """Frames partitioned by day, metadata beside them; a job's files appear together when it commits."""
    frames.write.mode("append").partitionBy("day").parquet(f"{path}/frames")
    meta.write.mode("append").partitionBy("day").json(f"{path}/meta")


def read_attempts(spark: SparkSession, path: str, frame_schema: str, meta_schema: str) -> DataFrame:
    meta = spark.read.schema(meta_schema).json(f"{path}/meta")
    return spark.read.schema(frame_schema).parquet(f"{path}/frames").join(meta.drop("day"), "attempt")


def output_manifest(frames: DataFrame, seen: Column, provenance: list[str]) -> DataFrame:
    """series, n_frames, dropout (four places) and provenance read back from the data, "unknown" where it is missing."""
    return frames.groupBy("series").agg(F.count("*").alias("n_frames"), F.round(F.avg(F.when(seen, 0.0).otherwise(1.0)), 4).alias("dropout"), *[F.coalesce(F.max(p), F.lit("unknown")).alias(p) for p in provenance])


def save_state(state: DataFrame, path: str, version: int) -> None:
    """A snapshot of learner state; older versions stay."""
    state.write.mode("error").parquet(f"{path}/version={version}")


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest snapshot, or no rows (a fresh learner) where there is none."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = [int(m[1]) for s in (fs.listStatus(files) if fs.exists(files) else []) if (m := re.fullmatch(r"version=(\d+)", s.getPath().getName()))]
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/version={max(versions)}")


BLOB = "piece int, chunk int, first long, n long, content binary, runs array<struct<key: string, first: long, n: long>>"


def write_blob(rows: DataFrame, key: str, order: list[str], vector: str, path: str, chunk_rows: int = 4096) -> None:
    """Vectors (arrays of numbers, as long in every row) laid out by key and order: little-endian f32, one row after the other, in chunks, and an index by key.

    The rows are dealt by ranges of key and order, and each task packs its range (a piece). Where a piece begins follows from the sizes of those before it, a row
    for each piece, so the layout takes one pass over the rows and a running sum over the pieces. The index has key, start, count (rows); keys are strings.
    """
    ship(rows.sparkSession)
    laid = rows.select(F.col(key).cast("string").alias("_key"), *order, F.col(vector).cast("array<float>").alias("_v"))
    laid = laid.repartitionByRange("_key", *order).sortWithinPartitions("_key", *order).select("_key", "_v")
    run_type = pa.list_(pa.struct([("key", pa.string()), ("first", pa.int64()), ("n", pa.int64())]))
    schema = pa.schema([("piece", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("content", pa.binary()), ("runs", run_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        piece, chunk, first = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, chunk_rows):
                part = batch.slice(at, chunk_rows)
                keys, n = part.column("_key").to_pylist(), part.num_rows
                content = part.column("_v").flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()
                starts = [i for i in range(n) if not i or keys[i] != keys[i - 1]]
                runs = [{"key": keys[s], "first": first + s, "n": e - s} for s, e in zip(starts, [*starts[1:], n], strict=True)]
                columns = ([piece], [chunk], [first], [n], [content], [runs])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                chunk, first = chunk + 1, first + n

    laid.mapInArrow(run, BLOB).write.parquet(f"{path}/pieces")
    pieces = rows.sparkSession.read.schema(BLOB).parquet(f"{path}/pieces")
    sizes = pieces.groupBy("piece").agg(F.sum("n").alias("size"))
    sizes.select("piece", F.coalesce(F.sum("size").over(W.orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")).write.parquet(f"{path}/before")  # a row for each piece
    runs = pieces.select("piece", F.explode("runs").alias("r")).join(rows.sparkSession.read.parquet(f"{path}/before"), "piece")
    index = runs.groupBy(F.col("r.key").alias("key")).agg(F.min(F.col("before") + F.col("r.first")).alias("start"), F.sum("r.n").alias("count"))
    index.write.parquet(f"{path}/index")


def blob_index(spark: SparkSession, path: str) -> DataFrame:
    """key, start, count: where each key's rows stand in the whole."""
    return spark.read.parquet(f"{path}/index")


def read_blob(spark: SparkSession, path: str, start: int, count: int, width: int) -> DataFrame:
    """at (row of the whole), v (array of ``width``) of the ``count`` rows from ``start`` on; chunks outside the range are not handed to Python."""
    ship(spark)
    pieces = spark.read.schema(BLOB).parquet(f"{path}/pieces").join(spark.read.parquet(f"{path}/before"), "piece")
    at = F.col("before") + F.col("first")
    wanted = pieces.where((at < start + count) & (at + F.col("n") > start)).select(at.alias("at"), "content")
    schema = pa.schema([("at", pa.int64()), ("v", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, content in zip(batch.column("at").to_pylist(), batch.column("content").to_pylist(), strict=True):
                v = np.frombuffer(content, "<f4").reshape(-1, width)
                here = np.arange(first, first + len(v))
                inside = (here >= start) & (here < start + count)
                yield pa.RecordBatch.from_arrays([pa.array(here[inside]), pa.array(v[inside].tolist(), schema.field("v").type)], schema=schema)

    return wanted.mapInArrow(run, "at long, v array<float>")


def bundle_metadata(judged: DataFrame, key: str, multi: DataFrame) -> DataFrame:
    """key, meta: JSON with each parameter's value and whether it is judged, and whether the item has several parts."""
    g = judged.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("parameter", F.struct("value", "judged"))))).alias("parameters"))
    return g.join(multi, key).select(key, F.to_json(F.struct("parameters", "multi")).alias("meta"))


def review_rows(cases: DataFrame, tokens: DataFrame, picks: DataFrame) -> DataFrame:
    """sentence_id, review: JSON of a case with its glosses in order, each with the clip that was chosen or null."""
    t = tokens.join(picks.select("gloss", "video_id"), "gloss", "left").groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct("place", "gloss", "video_id"))).alias("glosses"))
    df = cases.join(t, "sentence_id", "left")
    return df.select("sentence_id", F.to_json(F.struct("reason", F.coalesce("glosses", F.expr("cast(array() as array<struct<place: int, gloss: string, video_id: bigint>>)")).alias("glosses")), {"ignoreNullFields": "false"}).alias("review"))


def coverage(cases: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """key, cases of all declared ids: a review sheet without a case for one of them (0) is incomplete."""
    counted = cases.groupBy(key).agg(F.count("*").alias("cases"))
    return declared.select(key).distinct().join(counted, key, "left").select(key, F.coalesce("cases", F.lit(0)).alias("cases"))


def assemble_layout(detections: DataFrame, slots: int) -> DataFrame:
    """frame, kp, score: detections (frame, slot, ord, score, x, y, width, height, mirrored) laid out by slot in pixels.

    In each slot the best score wins, the first on ties; a mirrored detection swaps the two hand slots (1 and 2); slots without a
    detection are zeros.
    """
    slot = F.when(F.col("mirrored") & (F.col("slot") == 1), 2).when(F.col("mirrored") & (F.col("slot") == 2), 1).otherwise(F.col("slot"))
    best = detections.withColumn("slot", slot).withColumn("_r", F.row_number().over(W.partitionBy("frame", "slot").orderBy(F.desc("score"), "ord"))).where("_r = 1")
    g = best.groupBy("frame").agg(F.map_from_entries(F.collect_list(F.struct(F.col("slot").cast("int"), F.struct((F.col("x") * F.col("width")).alias("x"), (F.col("y") * F.col("height")).alias("y"), "score")))).alias("m"))
    at = F.sequence(F.lit(0), F.lit(slots - 1))
    return g.select("frame", F.transform(at, lambda k: F.struct(F.coalesce(F.col("m")[k]["x"], F.lit(0.0)).alias("x"), F.coalesce(F.col("m")[k]["y"], F.lit(0.0)).alias("y"))).alias("kp"), F.transform(at, lambda k: F.coalesce(F.col("m")[k]["score"], F.lit(0.0))).alias("score"))
