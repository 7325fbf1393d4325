import hashlib
import re

import numpy as np

from seqloom.llm import decontaminate as op
from tests.llm.cases import awkward, empty


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items, width=13):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add(i)
    sizes = {len(w) for w in wins}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[k]
        names = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def made(spark):
    rng = np.random.default_rng(0)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab, rng.integers(0, 30)))) for i in range(30)] + [(30, None), (31, "Alpha, beta!"), (32, "alpha beta"), (9, "of the of the of the of the of the of the of the of"), (33, "Ünder ÜBER")]
    docs = []
    for i in range(60):
        body = list(rng.choice(vocab, rng.integers(0, 80)))
        if i % 3 == 0:
            body += (items[i % 30][1] or "").split()[: rng.integers(5, 30)]
        docs.append(" ".join(body))
    docs += [None, "", "ALPHA-beta alpha beta alpha", "of the " * 400, "Ünder ÜBER über", "x" * 3000]
    return awkward(spark, docs), spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, word string"), items


def check(spark, docs, bench, items):
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in op.contamination(docs, bench).collect()), key=str)
    assert got == plain([(r["doc_id"], r["text"]) for r in docs.collect()], items)


def test_equals_brute_force(spark):
    check(spark, *made(spark))


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(op, "BROADCAST_WORDS", 0)
    check(spark, *made(spark))


def test_empty(spark):
    docs, bench, _ = made(spark)
    assert op.contamination(empty(spark), bench).count() == 0
    rows = op.contamination(docs, bench.where("false")).collect()
    assert len(rows) == docs.count() and not any(r["contaminated"] for r in rows)


def test_proximity(spark):
    lists = spark.createDataFrame([(1, "a", 0), (1, "b", 3), (1, "b", 9), (1, "a", 12), (2, "a", 5), (2, "b", 5 + 4)], "key long, word string, pos int")
    got = {tuple(r) for r in op.proximity(lists, "a", "b", 3).select("key", "left_pos", "right_pos").collect()}
    assert got == {(1, 0, 3), (1, 12, 9)}


def test_row_keys_tell_ids_and_texts_apart(spark):
    rows = [(None, None), (None, ""), (None, "."), (None, "1"), (1, None), (1, ""), (1, "."), (1, "1"), (11, ""), (11, None), (1, "x"), (None, "1:x"), (-1, "x")]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    keys = [bytes(r["k"]) for r in docs.select(op.row_key(docs).alias("k")).collect()]
    assert len(set(keys)) == len(rows) and keys[len(rows) :] == keys[:3] and {len(k) for k in keys} == {16}
