import math
import os
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seqloom.llm import lm_model as model
from seqloom.llm import lm_score as op
from seqloom.llm.common import held_out, most_frequent
from tests.llm.cases import awkward, empty

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
END = model.subwords(PATH).n_vocab


def plain(rows):
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows}
    c = Counter(w for r in rows if not held[r["doc_id"]] for w in words(r["text"]))
    n, v = sum(c.values()), len(c)
    return sorted((r["doc_id"], held[r["doc_id"]], len(words(r["text"])), sum(c[w] > 0 for w in words(r["text"])), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(r["text"])), 6)) for r in rows)


def scored(docs, steps=3, rounds=1):
    df = docs.select("doc_id", "text", held_out(F.col("doc_id"), 7).alias("held_out"))
    return op.score(df, PATH, steps, rounds)


def test_base_equals_plain_counts(spark, monkeypatch):
    docs = awkward(spark)
    for frequent in (5, 200_000):  # nearly all words joined, or none
        monkeypatch.setattr(op, "FREQUENT", frequent)
        rows = scored(docs).collect()
        got = sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
        assert got == plain(docs.collect())
        assert all(r["score"] < 0 for r in rows)
    assert scored(empty(spark)).count() == 0


def words_of(texts):
    return [t.lower().split() for t in texts]


def prior_of(texts, kept=10**9, sample=None):
    """The prior of the texts by plain loops over their words, with the ``kept`` most frequent followers."""
    starts = model.starts_of(PATH)
    singles, grams = (np.zeros(len(starts)), np.zeros(len(starts))), Counter()
    coded = [model.encode(w, PATH) for w in words_of(texts)]
    for ids in (w for t in coded for w in t):
        singles[0][ids[0]] += 1
        for i in [*ids[1:], END]:
            singles[1][i] += 1
        for j in range(len(ids)):
            follow = ids[j + 1] if j + 1 < len(ids) else END
            for level in range(min(j, 2) + 1):
                context = (level, *((ids[: j + 1]) if level == 2 else ids[j - level : j + 1]))
                grams[context, follow] += 1
    key = {}
    for ids in {tuple(w) for t in coded for w in t}:
        flat = model.Flat([ids], END)
        for j in range(len(ids)):
            for level in range(min(j, 2) + 1):
                key[(level, *((ids[: j + 1]) if level == 2 else ids[j - level : j + 1]))] = int(flat.contexts[level][j])
    kept = dict(grams.most_common(kept)) if kept < len(grams) else grams
    contexts = []
    by_context: dict = {}
    for (c, f), n in grams.items():
        by_context.setdefault(c, {})[f] = n
    for c in {c for c, _ in kept}:
        mine = by_context[c]
        own = {f: n for f, n in mine.items() if (c, f) in kept}
        contexts.append((key[c], sum(mine.values()), len(mine), list(own), list(own.values())))
    label = model.classes([np.array([i for w in t for i in w], np.int64) for t in coded], starts, np.random.default_rng(0))
    return model.Prior(starts, label, len(texts), singles, contexts), grams, set(kept)


TEXTS = [b"the cat sat on the mat and the other cat " * 5, b"mitochondria and the theatre, theatrical cats " * 4, b"antidisestablishment the antibody " * 3]


def test_prior_equals_plain_interpolation():
    prior, grams, kept = prior_of(TEXTS, kept=40)
    totals, different = Counter(), Counter()
    for (c, _), n in grams.items():
        totals[c] += n
        different[c] += 1
    held = Counter()
    for c, f in kept:
        held[c] += grams[c, f]

    def p(ids, follow):
        out = prior.single[follow]
        for level in range(min(len(ids) - 1, 2) + 1):
            c = (level, *(ids if level == 2 else ids[len(ids) - 1 - level :]))
            if c in held:
                back = totals[c] - held[c] + model.FOLLOWERS * different[c]
                out = ((grams[c, follow] if (c, follow) in kept else 0) + back * out) / (held[c] + back)
        return out

    rest = np.flatnonzero(~model.starts_of(PATH)).tolist()
    for word in (b"theatre", b"antidote", b"catastrophe,"):
        [ids] = model.encode([word], PATH)
        rec = np.frombuffer(prior.records([ids])[0], model.RECORD)
        for j in range(len(ids)):
            follow = ids[j + 1] if j + 1 < len(ids) else END
            kind = prior.kind[follow]
            of_kind = sum(p(tuple(ids[: j + 1]), f) for f in rest if prior.kind[f] == kind)
            assert abs(rec["after"][j][kind] - math.log(of_kind)) < 0.02 * max(1, abs(math.log(of_kind)))
            if follow != END:
                assert abs(rec["within"][j + 1] - math.log(p(tuple(ids[: j + 1]), follow) / of_kind)) < 1e-3


def test_counts_of_the_table_equal_plain_counts(spark):
    docs = awkward(spark)
    counts = op.word_counts(docs)
    got = {(r["context"], r["following"]): r["n"] for r in op.gram_table(counts, PATH).collect()}
    want = Counter()
    for r in docs.collect():
        for ids in model.encode((r["text"] or "").encode().lower().split(), PATH):
            flat = model.Flat([ids], END)
            want[0, ids[0]] += 1
            for f in [*ids[1:], END]:
                want[1, f] += 1
            for j in range(len(ids)):
                for level in range(min(j, 2) + 1):
                    want[int(flat.contexts[level][j].astype(np.int64)), ids[j + 1] if j + 1 < len(ids) else END] += 1
    assert got == want


def test_most_frequent(spark):
    df = spark.createDataFrame([(i, i // 3 + 1) for i in range(600)], "i int, n long")
    for most in (0, 10, 100, 450, 600, 10_000):
        kept = {r["i"] for r in df.where(most_frequent(df, "n", most)).collect()}
        assert len(kept) <= most and len(kept) >= min(600, most) - 12
        assert all(i in kept for i in range(600) if i // 3 > min((k // 3 for k in kept), default=999))


def built(seed=0, steps=20):
    prior, _, _ = prior_of(TEXTS)
    made = model.Model(prior, model.init(np.random.default_rng(seed)))
    words = op.Words(prior, PATH, {})
    made.fit(words.of(words_of(TEXTS))[0], np.random.default_rng(seed), steps)
    return made, words


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in model.init(rng).items()}
    p["top"] += rng.normal(size=p["top"].shape)
    c, o = rng.integers(0, len(p["cls"]), (3, model.SPAN)), rng.integers(0, 50, (3, model.SPAN))
    goal, live, prior = rng.integers(0, model.CLASSES, (3, model.LIVE)), rng.random((3, model.LIVE)) < 0.8, rng.normal(size=(3 * model.LIVE, model.CLASSES))
    _, d = model.gradients(p, c, o, prior, goal, live)
    for k in p:
        at = np.unravel_index(np.abs(d[k]).argmax(), d[k].shape)
        was = p[k][at]
        p[k][at] = was + 1e-4
        up, _ = model.gradients(p, c, o, prior, goal, live)
        p[k][at] = was - 1e-4
        down, _ = model.gradients(p, c, o, prior, goal, live)
        p[k][at] = was
        assert abs((up - down) / 2e-4 - d[k][at]) < 1e-3 * max(1, abs(d[k][at]))


@pytest.mark.parametrize("n", [1, 5, model.LIVE, model.LIVE + 1, 200, 1000])
def test_windows_score_each_id_once_after_enough_context(n):
    before, goal, live, owner = model.layout([np.zeros(3, model.RECORD), np.zeros(n, model.RECORD)])
    start = 3 + model.OVERLAP + 1  # where the second text's places begin
    hit = Counter((goal[owner == 1] - start - model.OVERLAP - 1)[live[owner == 1]].tolist())
    assert hit == Counter(range(n))
    assert (before[owner == 1] >= start).all() and (goal[:, 0] - before[:, 0] > model.OVERLAP).all()


def test_scores_equal_a_loop_over_single_ids():
    """Windows, masks and batches against attention computed for one id at a time, also over several windows."""
    made, words = built()
    p, prior = made.p, made.prior
    texts = words.of([*((t * 6).lower().split() for t in TEXTS), [], [b"cat"]])[0]

    def one(rec):
        total, size = 0.0, len(prior.label)
        ids = [size] * (model.OVERLAP + 1) + [int(i) for i in rec["id"]]
        for t in range(len(rec)):
            first = t // model.LIVE * model.LIVE  # of the window
            seen = ids[first : t + model.OVERLAP + 1]
            label = [model.CLASSES if i == size else prior.label[i] for i in seen]
            own = [model.OWN if i == size else i % model.OWN for i in seen]
            x = p["cls"][label] + p["own"][own] + p["pos"][: len(seen)]
            kv = x @ p["kv"]
            a = kv[:, : model.WIDTH] @ (x[-1] @ p["q"]) / model.WIDTH**0.5
            a = np.exp(np.clip(a, -30, 30))
            y = x[-1] + (a / a.sum()) @ kv[:, model.WIDTH :] @ p["out"]
            z = y + np.maximum(y @ p["w1"] + p["b1"], 0) @ p["w2"]
            after = rec["after"][t - 1].astype(float) if t else np.array([0] + [-20] * model.RESTS)
            g = z @ p["top"] + p["bias"] + np.concatenate([after[0] + prior.start_class, after[1:]])
            total += g[rec["cls"][t]] - np.log(np.exp(g - g.max()).sum()) - g.max() + rec["within"][t]
        return total / math.log(10)

    np.testing.assert_allclose(made.score(texts), [one(t) for t in texts], rtol=1e-4)


def test_probabilities_sum_to_one():
    made, words = built()
    starts = model.starts_of(PATH)
    end = np.frombuffer(made.prior.end_record(), model.RECORD)
    for before in ([], [b"the"], [b"antidisestablishment", b"theatre"]):
        ids = model.encode(before, PATH)
        fixed = np.concatenate([np.frombuffer(made.prior.records([w])[0], model.RECORD) for w in ids] + [end[:0]])
        base = made.score([fixed])[0] if before else 0.0
        ways = [np.concatenate([fixed, end])]
        if before:
            ways += [np.concatenate([fixed[: len(fixed) - len(ids[-1])], np.frombuffer(made.prior.records([[*ids[-1], i]])[0], model.RECORD)]) for i in range(END) if not starts[i]]
        firsts = made.prior.records([[i] for i in np.flatnonzero(starts)])
        ways += [np.concatenate([fixed, np.frombuffer(r, model.RECORD)]) for r in firsts]
        total = sum((10.0 ** (made.score(ways[a : a + 4096]) - base)).sum() for a in range(0, len(ways), 4096))
        assert abs(total - 1) < 2e-3


def test_learns(spark, sf):
    """Better than counting words, on texts that were learned from and on others; the smallest table has too few words for that."""
    larger = f"{os.path.dirname(sf.rstrip('/'))}/sf0.01"
    rows = op.op3_lm_scoring(spark, larger if os.path.isdir(larger) else sf).groupBy("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).collect()
    assert len(rows) == 2 and all(r["score"] > r["base"] for r in rows)


def test_rounds_average_all_tasks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit(False).alias("held_out")).repartition(3)
    counts = op.word_counts(docs).cache()
    texts = docs.count()
    start, later = (op.model_of(docs, counts, texts, PATH, "k", 5, rounds) for rounds in (0, 2))
    assert any(np.abs(start.p[k] - later.p[k]).max() > 1e-4 for k in start.p)
    assert all(np.isfinite(v).all() and v.shape == start.p[k].shape for k, v in later.p.items())


def test_sample_is_bounded_and_has_equal_rows_once(spark, monkeypatch):
    monkeypatch.setattr(op, "SAMPLE_TEXTS", 60)
    rows = [(None, "same text " * 3000)] * 300 + [(i, f"text {i} " * (3 + i)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sample = op.warm_start(docs, 600)
    assert 10 < len(sample) < 90 and max(map(len, sample)) <= op.STRETCH and len(set(sample)) == len(sample)
    many = spark.range(2_000).selectExpr("id doc_id", "cast(id as string) text")
    assert op.drawn(many, 1e-12, 0).count() == 0 and op.drawn(many, 1.0, 0).count() == 2000 and 300 < op.drawn(many, 0.2, 0).count() < 500


def test_words_encoded_together_equal_single_words():
    one = model.subwords(PATH).encode_ordinary
    odd = ["a ", " x", "　", "'s", "''", "\x1c", "\x85b", "﻿a", "日本", "123abc!!", "", "İ", "it's"]
    for words in (odd, [w for w in odd if w.split() == [w]] * 200, [f"w{i}" for i in range(2000)], []):
        assert model.encode([w.encode() for w in words], PATH) == [one(" " + w) for w in words]


def test_places_find_what_is_there():
    keys = np.random.default_rng(0).choice(1 << 40, 3000, replace=False).astype(np.uint64) << np.uint64(20)
    at, there = model.Places(keys[:2000]).find(np.concatenate([keys, keys[:10]]))
    assert there.tolist() == [True] * 2000 + [False] * 1000 + [True] * 10
    assert at[there].tolist() == [*range(2000), *range(10)]
    assert not model.Places(keys[:0]).find(keys)[1].any()


def test_words_stay_the_same_when_generations_go(monkeypatch):
    prior, _, _ = prior_of(TEXTS)
    tier = {b"the": 2.5, b"cat": 0.5}
    monkeypatch.setattr(op, "CACHE_WORDS", 3)
    words, end = op.Words(prior, PATH, tier), np.frombuffer(prior.end_record(), model.RECORD)
    texts = [*words_of(TEXTS), [], [b"the"], [f"w{i}".encode() for i in range(9)]]
    for _ in range(3):
        for at in range(len(texts)):
            got, logs = words.of(texts[at : at + 2])
            for t, rec, log in zip(texts[at : at + 2], got, logs, strict=True):
                assert rec.tobytes() == b"".join(prior.records(model.encode(t, PATH))) + end.tobytes()
                assert log.tolist() == [tier.get(w, -1.0) for w in t]


def many(spark, n=300):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"{'the of cat mat'.split()[k % 4]} {chr(97 + k)}{k}" for k in rng.integers(0, 20, 30).tolist())) for i in range(n)]
    return spark.createDataFrame([*rows, (None, None), (None, "the cat"), (0, rows[0][1])], "doc_id long, text string").repartition(3)


def test_classes_come_from_all_texts(spark, monkeypatch):
    """Against plain loops over all pairs, and against classes of all texts; a sample of a few texts has others."""
    monkeypatch.setattr(op, "SAMPLE_TEXTS", 3)
    docs = many(spark)
    coded = [np.array([i for w in model.encode((r["text"] or "").encode().lower().split(), PATH) for i in w], np.int64) for r in docs.collect()]
    counts = np.bincount(np.concatenate(coded), minlength=END + 1)
    top = model.most_met(counts)
    want, pairs = np.zeros((END + 1, model.MET)), 0
    place = {int(i): k for k, i in enumerate(top)}
    for ids in coded:
        for a, i in enumerate(ids):
            for b in (a + s * k for s in (-1, 1) for k in model.DISTANCES):
                if 0 <= b < len(ids):
                    pairs += 1
                    if int(ids[b]) in place:
                        want[i, place[int(ids[b])]] += 1
    got, met = op.neighbours(docs, top, PATH)
    assert met == pairs and (got == want).all()
    made = op.model_of(docs, op.word_counts(docs).cache(), len(coded), PATH, "classes", 1, 0)
    assert (made.prior.label == model.classes(coded, model.starts_of(PATH), np.random.default_rng(0))).all()


def test_fit_sees_all_training_texts_once(spark, monkeypatch):
    """The windows of all rounds are those of all texts, also where hardly any text is in the sample."""
    monkeypatch.setattr(op, "SAMPLE_TEXTS", 3)
    docs = many(spark)
    prior, _, _ = prior_of(TEXTS)
    start = model.init(np.random.default_rng(0))
    want = sum(-(-(sum(map(len, model.encode((r["text"] or "").encode().lower().split(), PATH))) + 1) // model.LIVE) for r in docs.collect())
    for rounds in (1, 3):
        made = op.fitted(model.Model(prior, {k: v.copy() for k, v in start.items()}), docs, PATH, "fit", rounds, {})
        assert made.windows == want
        assert any(np.abs(made.p[k] - start[k]).max() > 1e-4 for k in start)


def test_ids_and_sizes_equal_single_words():
    one = model.subwords(PATH).encode_ordinary
    words = [w.encode() for w in ["a", "it's", "　", "b　c", "123abc!!", *(f"w{i}" for i in range(2000))]] + [b"\xe2\x82", b"\xff"]
    ids, sizes = model.coded(words, PATH)
    want = [one(" " + w.decode("utf-8", "replace")) for w in words]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert [x.size for x in model.coded([], PATH)] == [0, 0]


def test_folded_products_equal_keys_and_values():
    """Folded products give what keys and values of all places give."""
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in model.init(rng).items()}
    x, prior = rng.normal(size=(3, model.SPAN, model.WIDTH)), rng.normal(size=(3 * model.LIVE, model.CLASSES))
    at = x + p["pos"]
    k, v = np.split(at @ p["kv"], 2, axis=2)
    own = at[:, model.OVERLAP :]
    a = np.exp(own @ p["q"] @ k.transpose(0, 2, 1) / model.WIDTH**0.5) * np.tri(model.LIVE, model.SPAN, model.OVERLAP)
    y = own + (a / a.sum(axis=2, keepdims=True)) @ v @ p["out"]
    want = (y + np.maximum(y @ p["w1"] + p["b1"], 0) @ p["w2"]) @ p["top"] + p["bias"]
    g, _ = model.forward(p, x.copy(), prior)
    np.testing.assert_allclose(g.T, want.reshape(-1, model.CLASSES) + prior, rtol=1e-5, atol=1e-5)
    ask, give = model.folded(p)
    np.testing.assert_allclose(own @ ask @ at.transpose(0, 2, 1), own @ p["q"] @ k.transpose(0, 2, 1) / model.WIDTH**0.5, rtol=1e-5, atol=1e-7)
    np.testing.assert_allclose(at @ give, v @ p["out"], rtol=1e-5, atol=1e-7)


def test_known_words_are_looked_up_once(monkeypatch):
    """A word is encoded when it is met first, also if it stands in a batch many times, and again only when both generations forgot it."""
    monkeypatch.setattr(op, "CACHE_WORDS", 40)
    coded = op.Coded(PATH)
    asked, learn = [], coded.learn
    coded.learn = lambda words: (asked.extend(words), learn(words))[1]
    for at in range(0, 90, 10):
        texts = [[f"w{i}".encode(), b"the"] * 5 for i in range(at, at + 10)]
        got, _ = coded.of(texts)
        assert [x.tolist() for x in got] == [[i for w in model.encode(t, PATH) for i in w] for t in texts]
    assert Counter(asked) == Counter([b"the", *(f"w{i}".encode() for i in range(90))])
