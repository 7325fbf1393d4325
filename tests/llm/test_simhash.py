import numpy as np
import xxhash

from seqloom.llm import simhash
from seqloom.llm.graph import components
from tests.llm.cases import awkward, empty


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(marks):
    """Smallest id reachable over links of at most three bits."""
    label = dict(enumerate(sorted(marks)))
    ids = sorted(marks)
    group = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if bin(marks[a] ^ marks[b]).count("1") <= 3 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    del label
    return group


def test_links_in_block_equal_brute_force():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, n, replace=False))) for b in base for n in (1, 3, 4, 5)]
    marks = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    for radius in (0, 1, 2, 3):
        found = set(zip(*(x.tolist() for x in simhash.links_in_block(marks, radius)), strict=True))
        wanted = {(i, j) for i in range(len(marks)) for j in range(i + 1, len(marks)) if bin(int(marks[i]) ^ int(marks[j])).count("1") <= radius}
        assert found == wanted


def test_near_duplicates(spark):
    docs = awkward(spark)
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    marks = {r["doc_id"]: plain(r["text"]) for r in docs.collect()}
    group = brute(marks)
    assert got == {(i, f"{m:016x}"): group[i] for i, m in marks.items()}
    assert simhash.near_duplicates(docs).count() == docs.count()


def test_hot_bucket_is_cut_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.default_rng(1)
    base = 0x0123456789ABCDEF
    marks = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (120, 2))}
    signed = [int(np.uint64(m).astype(np.int64)) for m in marks]
    edges = simhash.links(spark.createDataFrame([(m,) for m in signed], "fp long"))
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    group = brute({m: int(np.int64(m).astype(np.uint64)) for m in signed})
    assert {m: roots.get(m, m) for m in signed} == group


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
