import re

import numpy as np
from seqloom.llm import quality as op
from tests.llm.cases import awkward, empty


def plain(text):
    text = text or ""
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_counts_equal_plain_code(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(awkward(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    rows = spark.createDataFrame([(i, r["text"], r["lang"], r["source"]) for i, r in enumerate(docs.collect())], "doc_id long, text string, lang string, source string")
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    for r in op.counted(rows).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain(texts[r["doc_id"]])


def numpy_estimates(x):
    """The same steps for one group, in plain numpy."""
    floors = np.array(op.FLOORS)

    def at(v, q, grid):
        b = np.sort(grid(v))
        return b[int(np.ceil(q * len(b))) - 1]

    bins = lambda v: np.floor(v * op.GRID + 0.5)
    q1, q2, q3 = (np.array([at(x[:, i], q, bins) for i in range(x.shape[1])]) / op.GRID for q in (0.25, 0.5, 0.75))
    mean, cov = q2, np.diag(((q3 - q1) / 1.349) ** 2)
    for step in range(op.STEPS + 1):
        z = np.linalg.solve(np.linalg.cholesky(cov + np.diag(floors**2)), (x - mean).T)
        d = (z**2).sum(axis=0)
        if step == op.STEPS:
            return d
        b = np.floor(np.log(d + 1e-9) * op.DISTANCE_GRID)
        edge = np.sort(b)[int(np.ceil(op.SUPPORT * len(b))) - 1]
        near = x[b <= edge]
        mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) * op.CONSISTENCY


def test_distances_equal_numpy(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g, n in (("a", 300), ("b", 250)):
        for _ in range(n):
            w = int(rng.integers(60, 400))
            rows.append((len(rows), g, "s", w, int(w * rng.uniform(4, 6)), int(w * rng.uniform(0, 0.1)), 0, int(w * rng.uniform(0, 0.2)), int(w * rng.uniform(0.5, 0.9))))
    counts = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_distinct long")
    got = {r["doc_id"]: r["distance"] for r in op.judged(counts, op.estimates(counts)).collect()}
    for g in "ab":
        own = [r for r in rows if r[1] == g]
        x = np.array([(np.log(r[4] / r[3]), np.log(r[8]) / np.log(1 + r[3]), np.sqrt(r[5] / r[4]), np.sqrt(r[7] / r[3])) for r in own])
        np.testing.assert_allclose([got[r[0]] for r in own], numpy_estimates(x), rtol=1e-6)


def test_junk_goes_and_clean_stays(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(400)]
    clean = [" ".join(rng.choice(words, 120)) for _ in range(400)]
    junk = [" ".join(w + "%%%" for w in rng.choice(words, 120)) for _ in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in op.kept_documents(docs, op.estimates(op.counted(docs))).collect()}
    assert kept == set(range(400))


def test_awkward(spark):
    docs = awkward(spark)
    counts = op.counted(docs)
    rows = op.judged(counts, op.estimates(counts)).collect()
    assert len(rows) == docs.count()
    assert not any(r["kept"] for r in rows if r["base_failed"])
    assert op.kept_documents(docs, op.estimates(counts)).columns == docs.columns
    none = empty(spark)
    assert op.kept_documents(none, op.estimates(op.counted(none))).count() == 0
    short = awkward(spark, [None, "a", "b c"])
    assert op.kept_documents(short, op.estimates(op.counted(short))).count() == 0


def test_no_python_in_the_plan(spark, sf):
    counts = op.counted(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = op.judged(counts, op.estimates(counts))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_each_rate_can_reject_by_itself(spark):
    rng = np.random.default_rng(2)
    row = lambda symbols=0, lines=0, repeats=0, stretch=1.0: ("en", "s", 200, int(200 * rng.normal(5, 0.1) * stretch), symbols, lines, 20, repeats, int(rng.normal(150, 3)))
    clean = [row(symbols=int(i % 20 == 0), repeats=6 * (i % 20 == 1), lines=int(i % 20 == 2)) for i in range(400)]
    junk = [row(symbols=60), row(repeats=80), row(lines=8), row(stretch=1.6)]
    rows = [(i, *r) for i, r in enumerate(clean + junk)]
    counts = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, n_distinct long")
    kept = {r["doc_id"] for r in op.judged(counts, op.estimates(counts)).where("kept").collect()}
    assert not kept & set(range(400, 404))
    assert len(kept) >= 396
