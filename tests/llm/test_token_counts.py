import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqloom.llm import token_counts as op
from tests.llm.cases import awkward, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
PARTS = st.sampled_from(["The", "don't", "'s", "'", "'ll", "'r", "re", "ve", "'S", " ", "  ", "\n", " \n", "\t", "\r\n", "12", "é", " ", " ", "　", "中文", "\x1d", "\0", "!!", "x" * 80, "٣", "́", "\U0001f600", "\x85"])


def library(text):
    return [text[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(PARTS | st.text(max_size=5), max_size=20), max_size=5))
def test_pre_tokens_equal_the_library(lists):
    texts = ["".join(parts).encode("utf-8", "ignore").decode() for parts in lists]
    cut = op.Cut(texts)
    own = [[] for _ in texts]
    for i, u in zip(cut.owner.tolist(), cut.units(), strict=True):
        own[i].append(u.decode())
    for i, t in enumerate(texts):
        assert own[i] == library(t) or i in cut.unknown


def test_classes_equal_the_library():
    """Every assigned code point behind a letter, a digit and a mark: where it joins on."""
    kind = op.classes()
    points = [i for i in range(0, 0x30000, 3) if not 0xD800 <= i < 0xE000 and kind[i] != op.UNKNOWN]
    text = "".join(f"x{chr(i)}\n1{chr(i)}\n!{chr(i)}\n" for i in points)
    starts = np.zeros(len(text) + 1, bool)
    starts[[a for _, (a, _) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]] = True
    at = 9 * np.arange(len(points))
    joins = ~np.stack([starts[at + 1], starts[at + 4], starts[at + 7]])
    want = np.select([joins[0], joins[1], joins[2]], [op.LETTER, op.NUMBER, op.OTHER], op.SPACE)
    assert (kind[points] == want).all()


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_table_is_exact(n):
    units = {f"u{i}".encode(): 1 + i % 200 for i in range(n)} | {b"a": 1, b"a\0": 2, b"\0": 3, b"0123456789abcdef": 4}
    held = op.Table({**units, b"x" * 17: 5, b"": 6, b"long": 300})
    asked = [*units, b"", b"b", b"a\0\0", b"x" * 17, b"long", b"0123456789abcdeg"]
    data, size = b"".join(u.ljust(op.KEY_BYTES, b"\0")[: op.KEY_BYTES] for u in asked), np.array([len(u) for u in asked])
    keys = op.packed(np.frombuffer(data, np.uint8).reshape(-1, op.KEY_BYTES), size)
    assert held.lookup(keys, size).tolist() == [units.get(u, 0) for u in asked]


def test_counts(spark, monkeypatch):
    docs = awkward(spark)
    for size, cache in ((100, 500_000), (1, 2)):
        monkeypatch.setattr(op, "CACHE_UNITS", cache)
        got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in op.count_tokens(docs, PATH, size).collect())
        assert got == sorted((r["doc_id"], len((r["text"] or "").encode()), len(LIBRARY.encode(r["text"] or "").ids)) for r in docs.collect())


def test_special_strings_and_new_code_points(spark):
    texts = ["a <|endoftext|> b", "new \U0001ccf0\U0001ccf1 digits", "\U00016d40x", "<|endof", "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in op.count_tokens(docs, PATH).collect()} == {i: len(LIBRARY.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_whole_table_equals_the_library(spark, sf):
    rows = {r["doc_id"]: r for r in op.op1_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for r in docs:
        n = len(LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (rows[r["doc_id"]]["n_tokens"], rows[r["doc_id"]]["over_limit"], rows[r["doc_id"]]["n_bytes"]) == (n, n > 512, len((r["text"] or "").encode()))


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        op.load(public_tokenizers.path("word_bpe_49k.json"))


def test_empty(spark):
    assert op.count_tokens(empty(spark), PATH).count() == 0
