"""Importers: encodings, headers, binary layouts, state snapshots."""

import json

import pytest
from pyspark.sql import functions as F

from seqloom.operators import checks, rules, verdict
from seqloom.sources import files as op


def test_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Code,Name\n1,é中\n".encode())
    (tmp_path / "b.csv").write_bytes("Code,Name\n2,“œ”\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes("Code,Name\n3,é\x81\n".encode("latin-1"))
    got = {r["path"][-5:]: r["encoding"] for r in op.encodings(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": "utf-8", "b.csv": "windows-1252", "c.csv": "iso-8859-1"}
    assert {(r["Code"], r["Name"]) for r in op.read_csv(spark, str(tmp_path)).collect()} == {("1", "é中"), ("2", "“œ”"), ("3", "é\x81")}


def test_aliases():
    names = ["Participant ID", "Video file", "Gloss", "ASL-LEX Code"]
    want = {"signer": ("participant",), "video": ("video",), "gloss": ("gloss",), "code": ("code",)}
    assert op.resolve_columns(names, want) == {"signer": "Participant ID", "video": "Video file", "gloss": "Gloss", "code": "ASL-LEX Code"}
    with pytest.raises(KeyError):
        op.resolve_columns(names, {"split": ("split",)})


def test_headers(spark, tmp_path):
    (tmp_path / "one.csv").write_text("Entry ID, Code\n1,2\n")
    (tmp_path / "two.csv").write_text("code,movement\n1,2\n")
    found = op.headers(spark, str(tmp_path))
    assert {r["path"][-7:]: r["header"] for r in found.collect()} == {"one.csv": ["entry id", "code"], "two.csv": ["code", "movement"]}
    assert [r["path"][-7:] for r in op.choose_table(found, ["Code", "Movement"]).collect()] == ["two.csv"]
    assert sorted(r["path"][-7:] for r in op.choose_table(found, ["Entry ID", "Movement"]).collect()) == ["one.csv", "two.csv"]


def test_binary_attempts(spark):
    good = op.pack_attempt([0.0, 0.5], [[[1, 2], [3, 4]], [[5, 6], [7, 8]]], [[1, 0], [1, 1]], [0, 2])
    meta = {"format": op.FORMAT, "n_frames": 2, "n_keypoints": 2}
    times, kp, score, state = op.unpack_attempt(good, meta)
    assert times.tolist() == [0, 0.5] and kp[1].tolist() == [[5, 6], [7, 8]] and score.tolist() == [[1, 0], [1, 1]] and state.tolist() == [0, 2]
    for content, change in ((good[:-1], {}), (good, {"format": "other"}), (good, {"n_frames": 3})):
        with pytest.raises(ValueError):
            op.unpack_attempt(content, meta | change)
    blobs = spark.createDataFrame([("x", good, json.dumps(meta)), ("y", good, json.dumps(meta))], "attempt string, content binary, meta string")
    assert op.decode_attempts(blobs).count() == 4
    assert {r["attempt"] for r in op.decode_attempts(blobs, blobs.where("attempt = 'x'")).collect()} == {"y"}


def test_learner_state(spark, tmp_path):
    path, schema = str(tmp_path / "state"), "learner long, m double"
    assert op.load_state(spark, path, schema).count() == 0
    for v in (9, 10):
        op.save_state(spark.createDataFrame([(v, 0.5)], schema), path, v)
    assert op.load_state(spark, path, schema).first()["learner"] == 10


def test_layout_of_detections(spark):
    rows = [(1, 0, 0, 0.5, 0.1, 0.1, False), (1, 0, 1, 0.5, 0.9, 0.9, False), (1, 1, 0, 0.2, 0.5, 0.5, True), (1, 2, 1, 0.9, 0.25, 0.5, True)]
    df = spark.createDataFrame([(*r[:6], 100, 200, r[6]) for r in rows], "frame long, slot int, ord int, score double, x double, y double, width int, height int, mirrored boolean")
    r = op.assemble_layout(df, 4).first()
    assert [tuple(p) for p in r["kp"]] == [(10, 20), (25, 100), (50, 100), (0, 0)] and r["score"] == [0.5, 0.9, 0.2, 0]


def test_phrases_are_merged_from_the_left(spark):
    words = ["thank", "you", "thank", "thank", "you", "very", "much", "you"]
    df = spark.createDataFrame([(1, i, w, w) for i, w in enumerate(words)], "sentence_id long, i int, text string, lemma string")
    out = rules.merge_phrases(df, {("thank", "you", "very"): "TYV", ("thank", "you"): "TY", ("you", "very"): "YV", ("very", "much"): "VM"})
    assert [(r["i"], r["lemma"]) for r in out.orderBy("i").collect()] == [(0, "TY"), (2, "thank"), (3, "TYV"), (6, "much"), (7, "you")]


def test_surface_forms(spark):
    df = spark.createDataFrame([("cry", False, None), ("bake", False, None), ("go", False, ["went"]), ("the", True, None), ("play", False, None)], "w string, fixed boolean, irr array<string>")
    got = {r["w"]: set(r["f"]) for r in df.select("w", rules.surface_forms(F.col("w"), F.col("fixed"), F.col("irr")).alias("f")).collect()}
    assert got["cry"] == {"cry", "crys", "crying", "cryed", "cries", "cried"} and got["the"] == {"the"}
    assert got["bake"] == {"bake", "bakes", "bakeing", "bakeed", "baking", "baked"} and got["go"] >= {"went", "goes"} and "plaies" not in got["play"]


def test_minimal_pairs_and_partition(spark):
    df = spark.createDataFrame([(1, "a", "x", None), (2, "a", "y", None), (3, "b", "y", None), (4, "b", "y", 1)], "id long, f string, g string, h long")
    assert sorted(tuple(r) for r in checks.minimal_pairs(df, "id", ["f", "g", "h"]).collect()) == [(1, 2, "g"), (2, 3, "f"), (3, 4, "h")]
    points, regions = spark.range(4).withColumnRenamed("id", "idx"), spark.createDataFrame([(0, "a"), (1, "a"), (1, "b"), (3, "b")], "idx long, region string")
    assert sorted(tuple(r) for r in checks.partition_faults(points, regions).collect()) == [(1, 2), (2, 0)]


def test_hard_examples_and_lonely_labels(spark):
    df = spark.createDataFrame([(0, 1, 0, [0.0, 0.0]), (0, 2, 0, [3.0, 4.0]), (0, 3, 1, [1.0, 0.0])], "batch long, vec_id long, label int, embedding array<float>")
    got = {r["vec_id"]: (r["positive"], r["negative"]) for r in verdict.hard_examples(df).collect()}
    assert got[1] == (5.0, 1.0) and got[3] == (None, 1.0)
    assert [tuple(r) for r in verdict.lonely(df).collect()] == [(0, 1)]


def test_encodings_of_a_file_in_many_splits(spark, tmp_path):
    lines = b"".join(b"%d,caf\xc3\xa9\n" % i for i in range(3000))
    (tmp_path / "good.csv").write_bytes(b"Code,Name\n" + lines)
    (tmp_path / "late.csv").write_bytes(b"Code,Name\n" + lines + b"9,caf\xe9\n")
    (tmp_path / "odd.csv").write_bytes(b"Code,Name\n9,\x9d\n" + lines)
    (tmp_path / "none.csv").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = op.encodings(spark, str(tmp_path))
        assert {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in found.collect()} == {"good.csv": "utf-8", "late.csv": "windows-1252", "odd.csv": "iso-8859-1"}
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["path"].rsplit("/", 1)[1]: r["length"] for r in op.listed(spark, str(tmp_path)).collect()} == {f: (tmp_path / f).stat().st_size for f in ("good.csv", "late.csv", "odd.csv")}


def test_a_blob_is_read_back_by_offset(spark, tmp_path):
    rows = [(f"k{(i * 7) % 5}" if i % 3 else "k1", i, [float(i), i / 2, -1.0]) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, i long, v array<double>").repartition(7)
    path = str(tmp_path / "blob")
    op.write_blob(df, "key", ["i"], "v", path, chunk_rows=16)
    laid = [v for _, _, v in sorted(rows)]
    index = {r["key"]: (r["start"], r["count"]) for r in op.blob_index(spark, path).collect()}
    assert sum(n for _, n in index.values()) == 500
    for key, (start, n) in index.items():
        got = sorted((r["at"], list(r["v"])) for r in op.read_blob(spark, path, start, n, 3).collect())
        assert got == [(start + k, laid[start + k]) for k in range(n)]
        assert [v for _, v in got] == [v for k, _, v in sorted(rows) if k == key]
    assert op.read_blob(spark, path, 500, 10, 3).count() == 0


def test_each_fault_of_a_clip_is_found(spark):
    good = [[[0.0, 1.0], [2.0, 3.0]]] * 3
    score, extra = [[0.5, 1.0]] * 3, [[0.0]] * 3
    nan, inf = float("nan"), float("inf")
    clips = [
        ("ok", "a", "a", good, score, extra, ""), ("ok b", "b", None, [[[0.0, 1.0]]] * 2, [[1.0]] * 2, None, ""), ("none", "a", None, None, score, extra, "missing arrays"),
        ("flat", "a", None, [[[0.0], [1.0]]] * 3, score, extra, "points without two coordinates"), ("empty", "a", None, [], [], [], "no frames"), ("short", "a", None, good, score[:2], extra, "keypoints and scores differ in frames"),
        ("k", "b", None, good, score, None, "wrong number of points"), ("nan", "a", None, [[[nan, 1.0], [2.0, 3.0]]] * 3, score, extra, "keypoints not finite"), ("inf", "a", None, good, [[inf, 1.0]] * 3, extra, "scores not finite"),
        ("gone", "a", None, good, score, None, "extra missing"), ("wide", "a", "b", good, score, [[0.0, 1.0]] * 3, "extra of the wrong shape; tag of another backend"), ("odd", "a", None, good, score, [[nan]] * 3, "extra not finite"),
        ("unknown", "c", None, good, score, extra, "wrong number of points"),
    ]
    df = spark.createDataFrame([c[:6] for c in clips], "clip string, backend string, tag string, keypoints array<array<array<double>>>, scores array<array<double>>, extra array<array<double>>")
    assert {r["clip"]: r["problems"] for r in checks.clip_problems(df, {"a": 2, "b": 1}, {"a": 1}).collect()} == {c[0]: c[6] for c in clips}


def test_minimal_pairs_in_blocks(spark, monkeypatch):
    """Against all pairs: nulls, copies, groups of several blocks; partners are the first of the pairs. Nothing is broadcast from the driver."""
    from seqloom.operators import learner

    monkeypatch.setattr(checks, "BLOCK", 4)
    rows = [(k, k % 3, None if k % 5 == 0 else k % 2, "c" if k % 7 else None, k * k % 4) for k in range(60)] + [(None, 1, 1, "c", 1)]
    df = spark.createDataFrame(rows, "id long, f int, g int, h string, e int")
    for exempt, spared in ((None, ()), ({"f": "e"}, ("e",))):
        want = []
        for x in rows[:-1]:
            for y in rows[:-1]:
                differ = {n for n, a, b in zip("fghe", x[1:], y[1:], strict=True) if a != b}
                want += [(x[0], y[0], n) for n in "fghe" if x[0] < y[0] and n in differ and differ - {n} <= ({*spared} if n == "f" else set())]
        pairs = checks.minimal_pairs(df, "id", ["f", "g", "h", "e"], exempt)
        assert sorted(map(tuple, pairs.collect())) == sorted(want)
        first = checks.first_partners(df, "id", ["f", "g", "h", "e"], exempt)
        assert sorted(map(tuple, first.collect())) == sorted(map(tuple, learner.partners(pairs).collect()))
        for made in (pairs, first):
            assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_partners_of_keys_that_stand_twice(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (2, "a", 0), (3, "b", 0)], "id long, f string, g int")
    from seqloom.operators import learner

    assert sorted(map(tuple, checks.first_partners(df, "id", ["f", "g"]).collect())) == sorted(map(tuple, learner.partners(checks.minimal_pairs(df, "id", ["f", "g"])).collect()))


def test_attempts_are_packed_without_an_object_for_each_frame():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from seqloom.plans.sources import _packed

    n, k = 2000, 200
    x = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(k, dtype=np.int32), n)), pa.array(np.arange(n * k) / 8), pa.array(np.arange(n * k, dtype=np.int32) % 2)], ["t", "energy", "p"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), x)], ["series", "x"])
    tracemalloc.start()
    last = None
    for last in _packed(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    row = last.slice(last.num_rows - 1).to_pylist()[0]
    times, kp, score, state = op.unpack_attempt(row["content"], json.loads(row["meta"]))
    assert row["attempt"] == "u1999" and times.tolist() == [t / 25 for t in range(k)] and kp[-1].tolist() == [[(n * k - 1) / 8, -1.0]]
    assert score[:, 0].tolist() == state.tolist() == [t % 2 for t in range(k)]


def test_review_query(spark, tmp_path):
    """The registered query on sentences that are empty, null, refused or without a clip."""
    from seqloom.plans.all import QUERIES, SQL
    from tests.oracle import connect, of_spark, of_sql

    texts = [(1, 1, "the of the. . xylo xylo"), (1, 2, None), (2, 1, "in the and the of on are"), (2, 2, "")]
    spark.createDataFrame(texts, "conv_id long, turn int, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(k, 5 * k % 7) for k in range(1, 7)], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = of_spark(QUERIES["io14_review_rows"](spark, str(tmp_path)))
    assert got == of_sql(connect(str(tmp_path)), SQL["io14_review_rows"]) and len(got[1]) > 3
