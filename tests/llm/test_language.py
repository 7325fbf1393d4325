import numpy as np

from seqloom.llm import language as op
from seqloom.llm.common import held_out
from tests.llm.cases import awkward, empty

from pyspark.sql import functions as F


def test_grams_equal_plain_code():
    texts = ["Hello, wörld! a", "", "x", "12 34", "ab cd"]
    code, owner, letters = op.grams(texts)
    for i, t in enumerate(texts):
        padded = " " * op.GRAM + "".join(c if c.isalpha() else " " for c in t.lower()) + " " * op.GRAM
        wanted = {padded[k : k + op.GRAM] for k in range(len(padded) - op.GRAM + 1) if padded[k : k + op.GRAM].count(" ") <= 1}
        assert len(set(code[owner == i].tolist())) == len(wanted)
        assert letters[i] == sum(c.isalpha() for c in t)


def test_filters_hold_what_was_put_in():
    rng = np.random.default_rng(0)
    codes = [rng.integers(0, 2**63, 500).astype(np.uint64) for _ in range(70)]  # more languages than a word has bits
    model = op.Model([f"l{i:02}" for i in range(70)], [1] * 70, list(enumerate(codes)), 1 << 14)
    for i in (0, 63, 64, 69):
        mask = np.full(500, 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k in range(op.HASHES):
            mask &= model.masks[i // 64, op.slots(codes[i], k, model.size)]
        assert ((mask >> np.uint64(i % 64)) & np.uint64(1)).all()


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op.op2_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.95


def test_awkward(spark):
    docs = awkward(spark, [None, "", "  123 !?", "the house and the garden", "la maison et le jardin " * 30, "the tree and the house " * 30, "zzzz"]).withColumn("held_out", held_out(F.col("doc_id"), 4))
    train = spark.createDataFrame([(i, "the house and the garden are green", "en") for i in range(5)] + [(9 + i, "la maison et le jardin sont verts", "fr") for i in range(5)] + [(20, None, "en"), (21, "lost", None)], "doc_id long, text string, lang string")
    rows = op.identify(docs, op.fit(train)).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    said = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert said[0] == said[1] == said[2] == "und"
    assert said[4] == "fr" and said[5] == "en" and said[6] == "en"
    nothing = op.fit(train.where("false"))
    assert {r["lang_pred"] for r in op.identify(docs, nothing).collect()} == {"und"}
    assert op.identify(empty(spark).withColumn("held_out", F.lit(True)), op.fit(train)).count() == 0


def test_predictions_equal_sets_of_slots():
    rng = np.random.default_rng(2)
    alphabets = {"aa": "abcdeé", "bb": "defghß", "cc": "xyzabд"}
    word = lambda lang: "".join(rng.choice(list(alphabets[lang]), int(rng.integers(1, 8))))
    train = {lang: [" ".join(word(lang) for _ in range(30)) for _ in range(20)] for lang in alphabets}
    found = [(i, np.unique(np.concatenate([op.grams([t])[0] for t in train[lang]]))) for i, lang in enumerate(sorted(alphabets))]
    model = op.Model(sorted(alphabets), [20, 20, 20], found, size=1 << 10)  # small, so that filters overlap
    held = {lang: {int(op.slots(codes[j : j + 1], k, 1 << 10)[0]) for j in range(len(codes)) for k in range(op.HASHES)} for lang, (_, codes) in zip(sorted(alphabets), found, strict=True)}
    texts = [" ".join(word(lang) for _ in range(12)) for lang in alphabets for _ in range(5)] + ["", "12 !", "ж", "abc xyz def"]

    def plain(text):
        codes = op.grams([text])[0]
        if not any(c.isalpha() for c in text):
            return "und", 0.0
        counts = {}
        for lang, slots in held.items():
            false = (len(slots) / (1 << 10)) ** op.HASHES
            hits = sum(all(int(op.slots(codes[j : j + 1], k, 1 << 10)[0]) in slots for k in range(op.HASHES)) for j in range(len(codes)))
            counts[lang] = max(0.0, (hits - len(codes) * false) / (1 - min(false, 0.999)))
        total = sum(counts.values())
        best = max(sorted(counts), key=lambda x: counts[x])
        return (best, counts[best] / total) if total > 0 else ("aa", 0.0)

    got = model.predict(texts)
    want = [plain(t) for t in texts]
    assert [g[0] for g in got] == [w[0] for w in want]
    np.testing.assert_allclose([g[1] for g in got], [w[1] for w in want], atol=1e-9)
