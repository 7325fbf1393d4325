import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqloom.llm import bpe
from tests.llm.cases import awkward, empty

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()


def plain(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return b"".join(i.to_bytes(4, "little") for i in ids), LIBRARY.decode(ids, skip_special_tokens=False)


PARTS = st.sampled_from(["The", "don't", "é", "é", " ", "  ", "\n", "\t", "<|endoftext|>", "<|start", "12", "€", "İ", "Σ", "中文", "\u0085", " ", " ", "​", "\x1c", "ﬁ", "!!", "x" * 40, "'s", "\U0001f600"])


@settings(max_examples=150, deadline=None)
@given(st.lists(PARTS | st.text(max_size=6), max_size=60))
def test_exact(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    assert bpe.codec(PATH).encode(text) == plain(text)


def test_cuts_follow_content():
    shared = " ".join(f"word{i * 7919 % 1009}" for i in range(2000))
    a, b = shared, "something before " + shared
    chunks = lambda t: {t[s:e] for s, e in zip([0, *bpe.cuts(t)], bpe.cuts(t), strict=False)}
    assert "".join(a[s:e] for s, e in zip([0, *bpe.cuts(a)], bpe.cuts(a), strict=False)) == a
    assert len(chunks(a) & chunks(b)) >= len(chunks(a)) - 1
    own = bpe.codec(PATH)
    assert own.encode(a) == own.encode(a) == plain(a)
    assert own.encode(b) == plain(b)
    assert own.chunks


def test_long_texts_without_space():
    for text in ("a" * 30_000, "é" * 9000 + " b", "ab" * 20_000 + "\n"):
        assert bpe.codec(PATH).encode(text) == plain(text)


def test_joins_widen_until_they_agree():
    own = bpe.Codec(PATH)
    asked = []
    words = own.words
    own.words = lambda w: asked.append(list(w)) or words(w)
    done, coded = ["a", "bb", "cc"], words(["a", "bb", "cc"])
    own.join(done, coded, ["dd", "ee", "ff"], words(["dd", "ee", "ff"]), True)
    assert done == ["a", "bb", "ccdd", "ee", "ff"] and coded == words(done)
    assert asked == [["bb", "ccdd", "ee"]]
    asked.clear()
    wrong = ["aa", "bb", "ccdd", "ee", "ff"], words(["aa", "xx", "ccdd", "ee", "ff"])  # the word before the join is not as in the text
    own.join(*wrong, ["gg", "hh", "ii"], words(["gg", "hh", "ii"]), False)
    assert asked == [["ff", "gg"]]
    asked.clear()
    wrong = ["aa", "bb", "cc"], words(["aa", "xx", "xx"])
    own.join(*wrong, ["dd", "ee", "ff"], words(["dd", "ee", "ff"]), False)
    assert [len(w) for w in asked] == [2, 4, 6] and wrong[1] == words(["aa", "bb", "cc", "dd", "ee", "ff"])
    asked.clear()
    own.join(done, coded, ["gg"], words(["gg"]), False)
    assert done[-2:] == ["ff", "gg"] and coded == words(done) and asked == [["ff", "gg"]]


def test_chunks_of_any_size(monkeypatch):
    monkeypatch.setattr(bpe, "AVERAGE_BITS", 3)  # a cut after about eight code points
    texts = ["Some words, and more of them; " * 40, "averylongwordwithoutspaces" * 30 + " end", " lead and trail \n" * 50]
    own = bpe.Codec(PATH)
    assert [own.encode(t) for t in texts * 2] == [plain(t) for t in texts * 2]


def test_a_megabyte_without_space_is_linear():
    text = "".join(chr(97 + i * 7919 % 26) for i in range(1_000_000))
    ids, decoded = bpe.codec(PATH).encode(text)
    assert len(ids) > 0 and decoded


def test_query_columns(spark):
    docs = awkward(spark)
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(bpe.encode(docs, PATH)).collect()}
    wanted = set()
    for r in docs.collect():
        ids, text = plain(r["text"])
        wanted.add((r["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == wanted
    assert bpe.digests(bpe.encode(empty(spark), PATH)).count() == 0
