import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from seqloom.llm import divergence
from tests.llm.cases import SCHEMA, awkward, empty


def brute(rows, least=10, top=10):
    """(lang, source, part, item, value, rank) from the definition."""
    docs = [tuple(x or "" for x in r) for r in rows]
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        of, q = {s: p(counts[lang, s]) for s in sources}, p(whole)
        for s in sources:
            pairs = [(-sum(f(of[s][t], of[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(of[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and of[s][t] > q[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def of(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


def random_docs(rng, n=150):
    words = [f"{a}{b}" for a in "aÀzß漢" for b in "bcdeFGé"]
    row = lambda: (None if rng.random() < 0.05 else " ".join(rng.choice(words, int(rng.integers(0, 40)), p=None)), rng.choice(["en", "de", None]), rng.choice([f"s{k}" for k in range(6)] + [None]))
    return [tuple(None if x is None else str(x) for x in row()) for _ in range(n)]


@pytest.mark.parametrize("sizes", [(1 << 18, 1 << 16, 1 << 20), (5, 3, 8)])
def test_equals_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("HELD", "TREE", "NODES"), sizes, strict=True):
        monkeypatch.setattr(divergence, name, value)
    rows = random_docs(np.random.default_rng(0))
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    assert of(divergence.audit(docs, least=4)) == brute(rows, 4)


def test_trees_add_each_node_and_ancestor_once():
    rng = np.random.default_rng(1)
    rows = sorted(tuple((int(s), int(rng.integers(5, 8))) for s in np.flatnonzero(rng.random(5) < 0.6)) for _ in range(200))
    rows = [r for r in rows if r]
    flat = [x for r in rows for x in r]
    times = rng.integers(1, 4, len(rows))
    a, b, rest = divergence.tree_rests(np.array([len(r) for r in rows]), np.array([x[0] for x in flat]), np.array([x[1] for x in flat]), np.full(len(flat), 2), times)
    wanted = Counter()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for r, n in zip(rows, times.tolist(), strict=True):
        for k, (t, q) in enumerate(r):
            for s, p in r[:k]:
                wanted[s, t] += n * (f(p, q) - f(p, 2) - f(2, q) + f(2, 2))
    assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), rest.tolist(), strict=True)) == dict(wanted)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
    assert of(divergence.audit(docs)) == brute(rows)
    assert of(divergence.audit(docs, least=1)) == brute(rows, 1)


def test_counts_beyond_a_long_of_scaled_numbers(spark):
    n = 10**11
    row = spark.range(1).select(divergence.probability(*(divergence.F.lit(x).cast("long") for x in (n, 3 * n, 7)))).first()
    assert row[0] == 1 + 10**9 * (n + 2) // (3 * n + 14)


def test_empty(spark):
    assert divergence.audit(empty(spark)).count() == 0
    assert divergence.audit(spark.createDataFrame([(None,) * 9], SCHEMA)).count() == 0
