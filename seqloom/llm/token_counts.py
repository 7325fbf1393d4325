"""Token counts of whole texts: a two-tier lookup of pre-tokens inside the map, without any shuffle of pre-tokens.

Texts are cut into pre-tokens, the parts that the tokenizer's merges never cross, in numpy over the code points of many texts at
once. Tier one is a broadcast hash table of frequent pre-tokens (``Table``): open addressing over arrays of the UTF-8 bytes, of
which a pre-token may have 16, and one byte for its length in tokens; a lookup compares the bytes themselves, so it is exact. Its
size is bounded by ``table_size``. Tier two is a bounded cache in each worker; pre-tokens in neither are encoded by the library and
remembered. The table only makes lookups fast: which pre-tokens it holds comes from a bounded sample, about ``SAMPLE_TEXTS`` texts drawn by a hash
of id and text and counted in their tasks, of which each task reports at most ``TASK_REPORT``; no count depends on it.

Null and empty texts have 0 tokens; equal rows get equal counts, null ids are kept, other columns are ignored. A text that holds a
special token's string, or a code point that Python's tables don't know (they may be older than the library's), is encoded whole by
the library. The cut follows the tokenizer's byte-level pattern, which ``load`` checks for.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import as_text, record_batch, slices, table, workers_see_package

#: Pre-tokens in the broadcast table; bytes of the longest one there; characters of the longest one that a worker remembers.
TABLE_SIZE, KEY_BYTES, LONGEST = 65_536, 16, 64
SAMPLE_TEXTS, TASK_REPORT, CACHE_UNITS = 4_000, 8_192, 500_000
#: Code points that are cut together.
TOGETHER = 1_000_000
#: Classes of code points.
OTHER, LETTER, NUMBER, SPACE, UNKNOWN, BORDER = range(6)
#: Code points with the property White_Space.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

_tokenizers: dict[str, object] = {}
_caches: dict[str, dict[bytes, int]] = {}


def load(path: str):
    """The library's tokenizer of a .json file, without truncation and padding, and its special strings; one for each process and path."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) != ("ByteLevel", False, True):
            raise ValueError(f"{path} does not cut texts by the byte-level pattern alone")
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        specials = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        _tokenizers[path] = (tokenizer, specials)
    return _tokenizers[path]


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((UNKNOWN if (c := unicodedata.category(chr(i))) == "Cn" else kinds.get(c[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE)] = SPACE
    return out


class Cut:
    """The pre-tokens of several texts: ``data`` (UTF-8 of all), and for each pre-token its first byte, its end and its text's number."""

    def __init__(self, texts: list[str]) -> None:
        joined = "\0".join([*texts, ""])  # what stands between is made a border below
        self.data = joined.encode()
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        borders = np.cumsum(sizes + 1) - 1
        kind = classes()[points]
        self.unknown = np.unique(np.searchsorted(borders, np.flatnonzero(kind == UNKNOWN)))
        kind[borders] = BORDER
        n = len(points)
        change = np.append(True, kind[1:] != kind[:-1]) if n else np.zeros(0, bool)
        start = change.copy()
        heads = np.flatnonzero(change)
        ends = np.append(heads[1:], n)
        # white space before something else gives up its last character: a blank joins what follows, any other stands alone
        white = (kind[heads] == SPACE) & (ends < n)
        last = ends[white] - 1
        last = last[kind[last + 1] != BORDER]
        start[last] = True
        start[last[points[last] == 0x20] + 1] = False
        self._contractions(points, kind, start, heads, ends)
        first = np.flatnonzero(start)
        first = first[kind[first] != BORDER]
        stop = np.append(np.flatnonzero(start), n)
        stop = stop[np.searchsorted(stop, first, side="right")]
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(width)])
        self.first, self.stop = at[first], at[stop]
        self.owner = np.searchsorted(borders, first)

    @staticmethod
    def _contractions(points: np.ndarray, kind: np.ndarray, start: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> None:
        """An apostrophe that starts a pre-token takes s, t, m, d, re, ve or ll with it."""
        alone = heads[(ends - heads == 1) & (points[heads] == 0x27) & start[heads]]
        alone = alone[alone + 1 < len(points)]
        alone = alone[kind[alone + 1] == LETTER]
        one = points[alone + 1]
        two = points[np.minimum(alone + 2, len(points) - 1)]
        is_ = lambda p, signs: np.isin(p, [ord(c) for c in signs])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        takes = np.where(is_(one, "stmd"), 1, np.where(long, 2, 0))
        alone, takes = alone[takes > 0], takes[takes > 0]
        start[alone + 1] = False
        behind = alone + 1 + takes
        inside = behind[(behind < len(points))]
        start[inside[kind[inside] == LETTER]] = True

    def units(self) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.first.tolist(), self.stop.tolist(), strict=True)]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The first ``KEY_BYTES`` bytes of each pre-token as two numbers, and its number of bytes."""
        data = np.frombuffer(self.data + bytes(KEY_BYTES), np.uint8)
        size = self.stop - self.first
        return packed(np.lib.stride_tricks.sliding_window_view(data, KEY_BYTES)[self.first], size), size


def packed(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows of ``KEY_BYTES`` bytes as pairs of numbers, with zeros behind the first ``size`` bytes."""
    return (rows * (np.arange(KEY_BYTES)[None] < size[:, None])).view("<u8")


class Table:
    """An open-addressing hash table from pre-tokens to their numbers of tokens."""

    def __init__(self, counts: dict[bytes, int]) -> None:
        units = [(u, n) for u, n in counts.items() if 0 < len(u) <= KEY_BYTES and 0 < n < 256]
        self.slots = 1 << max(4, (4 * len(units)).bit_length())
        self.key, self.size, self.tokens = np.zeros((self.slots, 2), "<u8"), np.zeros(self.slots, np.uint8), np.zeros(self.slots, np.uint8)
        if not units:
            return
        rows = np.frombuffer(b"".join(u.ljust(KEY_BYTES, b"\0") for u, _ in units), np.uint8).reshape(-1, KEY_BYTES)
        size = np.array([len(u) for u, _ in units])
        keys = packed(rows, size)
        for slot, key, n, (_, tokens) in zip(self.slot(keys, size).tolist(), keys, size.tolist(), units, strict=True):
            while self.size[slot]:
                slot = (slot + 1) % self.slots  # noqa: PLW2901
            self.key[slot], self.size[slot], self.tokens[slot] = key, n, tokens

    def slot(self, keys: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = (keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (size.astype(np.uint64) << np.uint64(57))
        h ^= h >> np.uint64(32)
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.slots.bit_length() + 1)).astype(np.int64)

    def lookup(self, keys: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token, 0 where the table doesn't hold it."""
        out = np.zeros(len(keys), np.int64)
        open_ = np.flatnonzero(size <= KEY_BYTES)
        slot = self.slot(keys[open_], size[open_])
        while len(open_):
            held = self.size[slot]
            same = (held == size[open_]) & (self.key[slot] == keys[open_]).all(axis=1)
            out[open_[same]] = self.tokens[slot[same]]
            on = ~same & (held > 0)
            open_, slot = open_[on], (slot[on] + 1) % self.slots
        return out


def groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``TOGETHER`` code points."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > TOGETHER:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def frequent_units(docs: DataFrame, size: int, sample_texts: int = SAMPLE_TEXTS) -> list[bytes]:
    """The most frequent pre-tokens of a bounded sample, counted in its tasks."""
    rows = docs.count()
    most = min((1 << 63) - 1, int((2 * min(1.0, sample_texts / max(1, rows)) - 1) * (1 << 63)))
    schema = pa.schema([("unit", pa.binary()), ("n", pa.int64())])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in slices(batches):
            texts = as_text(part.column(0))
            for a, b in groups(texts):
                counts.update(Cut(texts[a:b]).units())
            if len(counts) > 50 * TASK_REPORT:
                counts = Counter(dict(counts.most_common(25 * TASK_REPORT)))
        top = [(u, n) for u, n in counts.most_common(TASK_REPORT) if len(u) <= KEY_BYTES]
        yield record_batch(schema, [u for u, _ in top], [n for _, n in top])

    drawn = docs.where(F.xxhash64("doc_id", "text") <= F.lit(most)).select("text")
    total: Counter = Counter()
    for r in drawn.mapInArrow(summarise, "unit binary, n long").toLocalIterator():
        total[bytes(r["unit"])] += r["n"]
    return [u for u, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size]]


def length_table(docs: DataFrame, tokenizer: str, size: int) -> Table:
    """The table of frequent pre-tokens that is broadcast."""
    encoder, _ = load(tokenizer)
    units = frequent_units(docs, size)
    lengths = encoder.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)
    return Table({u: len(e.ids) for u, e in zip(units, lengths, strict=True)})


def count_together(texts: list[str], known: Table, encoder, cache_: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, and the numbers of texts that hold an unknown code point."""
    cut = Cut(texts)
    keys, size = cut.keys()
    tokens = known.lookup(keys, size)
    missing = np.flatnonzero(tokens == 0)
    if len(missing):
        data = cut.data
        units = [data[a:b] for a, b in zip(cut.first[missing].tolist(), cut.stop[missing].tolist(), strict=True)]
        found = list(map(cache_.get, units))
        if None in found:
            if len(cache_) > CACHE_UNITS:
                cache_.clear()
            new = list(dict.fromkeys(u for u, n in zip(units, found, strict=True) if n is None))
            made = dict(zip(new, (len(e.ids) for e in encoder.encode_batch_fast([u.decode() for u in new], add_special_tokens=False)), strict=True))
            cache_.update((u, n) for u, n in made.items() if len(u) <= LONGEST)
            found = [made[u] if n is None else n for u, n in zip(units, found, strict=True)]
        tokens[missing] = found
    return np.bincount(cut.owner, weights=tokens, minlength=len(texts)).astype(np.int64), cut.unknown


def count_tokens(docs: DataFrame, tokenizer: str, table_size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of ``docs`` (doc_id, text); rows with equal ids stay rows of their own."""
    spark = docs.sparkSession
    workers_see_package(spark)
    shipped = spark.sparkContext.broadcast(length_table(docs, tokenizer, table_size))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, specials = load(tokenizer)
        own = _caches.setdefault(tokenizer, {})
        for part in slices(batches):
            texts = as_text(part.column("text"))
            totals = np.zeros(len(texts), np.int64)
            whole = {i for i, t in enumerate(texts) if specials.search(t)}
            for a, b in groups(texts):
                totals[a:b], unknown = count_together(texts[a:b], shipped.value, encoder, own)
                whole.update((a + unknown).tolist())
            for i in whole:
                totals[i] = len(encoder.encode(texts[i], add_special_tokens=False).ids)
            sizes = [0 if n is None else n for n in pc.binary_length(part.column("text").cast(pa.binary())).to_pylist()]
            yield record_batch(schema, part.column("doc_id"), sizes, totals)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
