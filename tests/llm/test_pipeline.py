import pytest

import corpus_pipeline
from seqloom.llm import decontaminate, pii, quality, simhash
from tests.llm.cases import SCHEMA, empty


def test_stages_keep_columns_and_take_effect(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        if name == "quality":
            counts = quality.counted(docs)
            want = {r["doc_id"] for r in quality.judged(counts, quality.estimates(counts)).where("kept").collect()}
        elif name == "simhash":
            want = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
        elif name == "decontamination":
            want = {r["doc_id"] for r in decontaminate.contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("not contaminated").collect()}
        else:
            want = set(left)
        rows = new.collect()
        assert {r["doc_id"] for r in rows} == want and len(rows) == len(want)
        if name == "pii":
            for r in rows:
                assert not pii.base_spans(r["text"] or "") or r["text"] != left[r["doc_id"]]
        if name != "bpe":
            assert new.columns == docs.columns
            left = {r["doc_id"]: r["text"] for r in rows}
        docs = new


def test_run_equals_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_empty_and_null_rows(spark, sf, stage):
    """Null and empty texts fail the quality rules, are copies of each other, and are otherwise left alone."""
    name, f = stage
    assert f(spark, empty(spark).select("doc_id", "text", "lang", "source", "n_chars"), sf).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None, None, None, None, None), (1, "", None, None, 0, 0, "", "", "")], SCHEMA)
    out = f(spark, odd, sf)
    left = [(r["doc_id"], None if name == "bpe" else r["text"]) for r in out.collect()]
    both = [(None, None), (1, None if name == "bpe" else "")]
    assert sorted(left, key=str) == sorted({"quality": [], "simhash": [(1, "")]}.get(name, both), key=str)
    assert name == "bpe" or out.columns == odd.columns


@pytest.mark.parametrize("few", [500_000, 0])
def test_near_duplicates_tell_rows_by_id_and_text(spark, sf, few, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_KEYS", few)
    text = lambda k: " ".join(f"w{k}x{i * k}" for i in range(80))
    rows = [(None, text(2)), (None, text(3)), (5, text(4)), (5, text(6)), (5, text(6)), (1, text(6)), (None, text(4)), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()]
    assert len(left) == 5 and set(left) == {(None, text(2)), (None, text(3)), (5, text(4)), (1, text(6)), (7, None)}


def test_near_duplicates_send_no_table_through_the_driver(spark, sf, monkeypatch):
    """However small Spark takes its tables for: a table that is exploded or packed well is expected to be small at any size."""
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_KEYS", 0)
    text = lambda k, last="": " ".join(f"w{k}x{i * k}" for i in range(200)) + last
    rows = [(k, text(k // 3, last), "en", "s", 1) for k, last in zip(range(3, 15), ["", " a", " b"] * 4, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = seen.executionsCount()
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()} >= {3, 6, 9, 12}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    made = seen.executionsList()
    plans = [made.apply(i).physicalPlanDescription() for i in range(before, made.size())]
    assert len(plans) > 5 and sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)
