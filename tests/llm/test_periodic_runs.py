from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from seqloom.llm import periodic_runs
from seqloom.llm.grammar import Grammar
from tests.llm.cases import awkward, empty


def brute(t, least=24, times=3):
    """(start, length, period) of all runs, by trying every period."""
    found = {}
    for q in range(1, len(t) // times + 1):
        x = 0
        while x < len(t) - q:
            start = x
            while x < len(t) - q and t[x] == t[x + q]:
                x += 1
            if x > start and x - start + q >= max(least, times * q):
                found.setdefault((start, x + q - start), q)
            x += x == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h, n = crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = planted(doc_id, (text or "").encode().split()) if doc_id is not None else (text or "").encode().split()
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *first, sha256(listed.encode()).hexdigest(), sha256(kept).hexdigest())


def series(rng):
    n, k = int(rng.integers(0, 130)), int(rng.integers(1, 5))
    s = rng.integers(0, k, n)
    for _ in range(int(rng.integers(0, 3)) if n else 0):
        a, p = int(rng.integers(0, n)), int(rng.integers(1, 14))
        b = int(rng.integers(a, n + 1))
        s[a:b] = np.resize(s[a : a + p], b - a)
    return s


@pytest.mark.parametrize("seed", range(4))
def test_extensions_equal_comparison_word_by_word(seed):
    rng = np.random.default_rng(seed)
    for _ in range(30):
        s = series(rng)
        n = len(s)
        full = np.concatenate([[9], s, [10]])
        grammar = Grammar(full)
        i, j = (a.ravel() for a in np.meshgrid(np.arange(1, n + 1), np.arange(1, n + 1)))
        i, j = i[i != j], j[i != j]
        after, before = grammar.forward(i, j), grammar.backward(i, j)
        for x in rng.integers(0, len(i), 100) if len(i) else ():
            low, high = sorted((int(i[x]), int(j[x])))
            assert after[x] == next(k for k in range(n + 2) if full[low + k] != full[min(high + k, n + 1)] or high + k == n + 1)
            assert before[x] == next(k for k in range(n + 2) if full[max(low - 1 - k, 0)] != full[high - 1 - k])


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("places", [periodic_runs.PLACES, 16])
def test_runs_equal_brute_force(seed, places, monkeypatch):
    monkeypatch.setattr(periodic_runs, "PLACES", places)
    rng = np.random.default_rng(seed)
    texts = [series(rng) for _ in range(60)]
    for least, times in ((24, 3), (6, 3), (8, 2)):
        found = periodic_runs.runs_of(texts, least, times)
        assert [[(s, e - s, q) for s, e, q in r.tolist()] for r in found] == [brute(t.tolist(), least, times) for t in texts]


def test_a_long_text_of_one_word_and_a_long_period(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PLACES", 4096)
    one, long = np.zeros(50_000, np.int64), np.resize(np.arange(7000), 50_000)
    assert [r.tolist() for r in periodic_runs.runs_of([one, long])] == [[[0, 50_000, 1]], [[0, 50_000, 7000]]]


def test_digests_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{x}" for x in series(rng)), None, None, None, 1, "w", "f", "k") for i in range(100, 260)]
    docs = awkward(spark).union(spark.createDataFrame(rows + [(None, "a b " * 30, None, None, None, 1, "w", "f", "k")], awkward(spark).schema))
    wanted = sorted(map(str, (expected(r["doc_id"], r["text"]) for r in docs.collect())))
    for batch in (periodic_runs.BATCH, 500):
        monkeypatch.setattr(periodic_runs, "BATCH", batch)
        got = periodic_runs.digests(docs, planted=True)
        assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == wanted


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "x " + "a b c " * 10 + "y\tz"), (2, "plain\n text"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic_runs.runs(docs).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(1, 30, 3)]
    assert got[1]["collapsed"] == "x a b c y z"
    assert (got[2]["runs"], got[2]["collapsed"]) == ([], "plain text")
    assert (got[3]["runs"], got[3]["collapsed"]) == ([], "")


def test_empty(spark):
    assert periodic_runs.digests(empty(spark), planted=True).count() == 0
    assert periodic_runs.runs(empty(spark)).count() == 0
    assert periodic_runs.runs_of([]) == []


def test_query_on_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(str, (tuple(r) for r in periodic_runs.op11_periodic_runs(spark, sf).collect())))
    assert got == sorted(map(str, (expected(r["doc_id"], r["text"]) for r in docs)))
