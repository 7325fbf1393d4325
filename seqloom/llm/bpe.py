"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last ``WINDOW`` code points cuts a text after about every ``AVERAGE`` of them, so passages that documents
share are cut alike wherever they stand. Each chunk is encoded as if it were a text. A worker keeps the encoded chunks that it met
twice (a hash is all that it keeps of those met once) and copies them from then on. Cuts fall anywhere, so joins are repaired: the
words about the cut are encoded again together, and if the outer words of that window don't come out as the chunks have them, the
window doubles on both sides, until both ends agree exactly or a side is used up. What stands beyond agreed words is as in the
whole text.

Documents never leave their task: ids that move between machines would cost more shuffle than the encoding they save, so reuse is
within a worker and its caches are bounded (``CHUNK_BYTES``, ``WORDS``, ``SEEN``); what falls out is encoded again.

Holds for tokenizers that drop white space and work on the parts between, such as word_bpe_49k.json. Null and empty texts have no
ids and an empty decoded text. A text with one of U+001C to U+001F, which Python counts as white space and the tokenizer does
not, is encoded whole by the library. Equal rows give equal results, null ids are kept, other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import as_text, record_batch, slices, table, workers_see_package

#: Code points in the rolling window (16) and between cuts: on average, and at most.
AVERAGE_BITS, LONGEST = 9, 8192
#: Bounds of a worker's caches: bytes of encoded chunks, words of each of two generations, hashes of chunks met once.
CHUNK_BYTES, WORDS, SEEN = 48_000_000, 300_000, 300_000
ODD = re.compile("[\x1c-\x1f]")
_MIX, _BASE = np.uint32(2654435761), np.uint32(0x9E3779B1)


def cuts(text: str) -> list[int]:
    """Where chunks end: after code points whose rolling hash has ``AVERAGE_BITS`` zeros, and after every ``LONGEST`` without one."""
    n = len(text)
    if n < 32:
        return [n]
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") * _MIX
    base = _BASE
    for step in (1, 2, 4, 8):  # hash of the last 2, 4, 8, 16
        wider = h.copy()
        wider[step:] += h[:-step] * base
        h, base = wider, np.uint32(int(base) * int(base) & 0xFFFFFFFF)
    ends = (np.flatnonzero(h >> np.uint32(32 - AVERAGE_BITS) == 0) + 1).tolist()
    out, last = [], 0
    for end in [*ends, n]:
        while end - last > LONGEST:
            last += LONGEST
            out.append(last)
        if end > last:
            out.append(end)
            last = end
    return out


class Codec:
    """The library's tokenizer with the caches of one worker."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # without a decoder in its file the library joins the tokens by spaces
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())] if self.tokenizer.decoder is None else None
        #: Ids (little-endian, 32 bits) and decoded text of words, in two generations.
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}
        self.chunks: dict[str, tuple[list[str], list[tuple[bytes, str]]]] = {}
        self.chunk_bytes = 0
        self.seen: set[int] = set()

    def decode(self, ids: bytes) -> str:
        if self.tokens is None:
            return self.tokenizer.decode(list(array("I", ids)), skip_special_tokens=False)
        tokens = self.tokens
        return " ".join([tokens[i] for i in array("I", ids)])

    def words(self, words: list[str]) -> list[tuple[bytes, str]]:
        """Ids and decoded text of each word."""
        out = list(map(self.young.get, words))
        if None not in out:
            return out
        if len(self.young) > WORDS:
            self.old, self.young = self.young, {}
        missing = {w: self.old.get(w) for w, x in zip(words, out, strict=True) if x is None}
        todo = [w for w, x in missing.items() if x is None]
        if todo:
            for w, e in zip(todo, self.tokenizer.encode_batch_fast(todo, add_special_tokens=False), strict=True):
                ids = array("I", e.ids).tobytes()
                missing[w] = (ids, self.decode(ids))
        self.young.update({w: x for w, x in missing.items() if len(w) <= 64})
        return [missing[w] if x is None else x for w, x in zip(words, out, strict=True)]

    def chunk(self, chunk: str) -> tuple[list[str], list[tuple[bytes, str]]]:
        """The words of a chunk, encoded as if it were a text."""
        known = self.chunks.get(chunk)
        if known is not None:
            return known
        words = chunk.split()
        entry = words, self.words(words)
        mark = hash(chunk)
        if mark in self.seen:
            size = 4 * len(chunk) + 140 * len(words) + 400
            if self.chunk_bytes + size > CHUNK_BYTES:
                self.chunks.clear()
                self.chunk_bytes = 0
            self.chunks[chunk] = entry
            self.chunk_bytes += size
        else:
            if len(self.seen) > SEEN:
                self.seen.clear()
            self.seen.add(mark)
        return entry

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids of the text and what they decode to."""
        if ODD.search(text):
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            return ids, self.decode(ids)
        words: list[str] = []
        coded: list[tuple[bytes, str]] = []
        start = last = 0
        for end in cuts(text):
            inside, last = text[last:end], end
            if end < len(text) and inside and not inside[-1].isspace() and len(inside.split(maxsplit=1)) == 1 and not inside[0].isspace():
                continue  # a piece of a longer word goes to the next chunk, or else its joins would encode the word again and again
            more, more_coded = self.chunk(text[start:end])
            if words and more:
                self.join(words, coded, more, more_coded, not text[start - 1].isspace() and not text[start].isspace())
            else:
                words += more
                coded += more_coded
            start = end
        coded = [c for c in coded if c[0]]
        return b"".join([c[0] for c in coded]), " ".join([c[1] for c in coded])

    def join(self, words: list[str], coded: list, more: list[str], more_coded: list, touching: bool) -> None:
        """Appends a chunk to what stands before it, with the join encoded again until it agrees with both sides."""
        size = 2 if touching else 1  # a joined word is neither of its parts, so its window begins with a word on each side
        while True:
            left, right = words[-size:], more[:size]
            window = [*left[:-1], left[-1] + right[0], *right[1:]] if touching else left + right
            again = self.words(window)
            # a side that is in the window as a whole has nothing beyond it that could differ
            if (again[0] == coded[-len(left)] or len(left) == len(words)) and (again[-1] == more_coded[len(right) - 1] or len(right) == len(more)):
                words[-len(left) :] = window
                coded[-len(left) :] = again
                words += more[len(right) :]
                coded += more_coded[len(right) :]
                return
            size *= 2


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded (text) for each row of ``docs`` (doc_id, text)."""
    workers_see_package(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for part in slices(batches):
            coded = [own.encode(t) for t in as_text(part.column("text"))]
            yield record_batch(schema, part.column("doc_id"), [c[0] for c in coded], [c[1] for c in coded])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    n_tokens = F.floor(F.octet_length("ids") / 4).cast("long")
    return encoded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
