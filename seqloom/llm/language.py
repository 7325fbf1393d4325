"""Language ID with language-bitmask n-gram filters.

The model is a table of ``SLOTS`` bit masks, one bit per language: the Bloom filters of all languages, bit-sliced, so that the
masks of an n-gram's slots, and-ed, give every language whose filter holds it. A language's filter holds the letter n-grams
that occur in at least ``MIN_SHARE`` of its training texts. A text's n-grams are looked up together in numpy; for each language
the hits of n n-grams are corrected for the filter's false positives, (hits - n f) / (1 - f), and the largest count decides. Its
share of all corrected counts is the score; ties go to the language that sorts first.

The model is fitted on a bounded sample of the training texts, about ``PER_LANGUAGE`` of each language drawn by a hash of id and
text; it is counted in the tasks, and the driver gets the n-grams that pass ``MIN_SHARE``.
N-grams are ``GRAM`` letters of the lower-cased text with a word's edge as a letter; everything that is no letter is an edge.
A null text, or one without a letter, gives ``und`` with score 0; so does everything where nothing was learned. A text with
letters but no known n-gram gives the language with the most training texts, with score 0. Very long texts count whole. Equal rows
get equal results, null ids are kept, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import as_text, held_out, record_batch, slices, table, workers_see_package

GRAM, HASHES = 4, 3
SLOTS = 1 << 18
PER_LANGUAGE, MIN_SHARE = 2000, 0.004
#: Code points of texts that are looked up together.
TOGETHER = 400_000
_EDGE = np.uint64(32)


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text number of every n-gram of the texts, and the number of letters of each text."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer((" " * GRAM).join(["", *lowered, ""]).encode("utf-32-le", "replace"), "<u4")
    owner = np.repeat(np.arange(len(texts)), [len(t) + GRAM for t in lowered]) if texts else np.zeros(0, np.int64)
    letter = _letters()[points]
    x = np.where(letter, points, 32).astype(np.uint64)
    n = len(x) - GRAM + 1
    code, edges = np.zeros(n, np.uint64), np.zeros(n, np.int8)
    for k in range(GRAM):
        code = code * np.uint64(0x100000001B3) + x[k : k + n]
        edges += ~letter[k : k + n]
    ok = np.flatnonzero(edges <= 1)
    code = code[ok]
    code ^= code >> np.uint64(29)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    code ^= code >> np.uint64(32)
    # the text that a window starts in; a window starts at most GRAM - 1 edges before its text
    starts = np.minimum(ok - 1, len(owner) - 1).clip(0)
    counts = np.bincount(owner[np.flatnonzero(letter[GRAM:]).clip(0, max(len(owner) - 1, 0))], minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    return code, owner[starts] if len(owner) else starts, counts


def slots(code: np.ndarray, k: int, size: int) -> np.ndarray:
    """The k-th slot of each n-gram."""
    step = (code >> np.uint64(32)) | np.uint64(1)
    return ((code + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)


class Model:
    """Bit-sliced filters of all languages: words of 64 languages, then slots."""

    def __init__(self, languages: list[str], texts: list[int], found: list[tuple[int, np.ndarray]], size: int = SLOTS) -> None:
        self.languages, self.texts, self.size = languages, texts, size
        self.masks = np.zeros((max(1, -(-len(languages) // 64)), size), np.uint64)
        self.false = np.zeros(len(languages))
        for i, codes in found:
            bit = np.uint64(1) << np.uint64(i % 64)
            for k in range(HASHES):
                self.masks[i // 64, slots(codes, k, size)] |= bit
            filled = np.count_nonzero(self.masks[i // 64] & bit) / size
            self.false[i] = filled**HASHES

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        code, owner, letters = grams(texts)
        at = [slots(code, k, self.size) for k in range(HASHES)]
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        counts = np.zeros((len(self.languages), len(texts)))
        for w, masks in enumerate(self.masks):
            mask = masks[at[0]]
            for a in at[1:]:
                mask &= masks[a]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                hits = np.bincount(owner, weights=(mask >> np.uint64(i % 64)) & np.uint64(1), minlength=len(texts))
                counts[i] = ((hits - total * self.false[i]) / (1 - min(self.false[i], 0.999))).clip(0)
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        best, summed = counts.argmax(axis=0), counts.sum(axis=0)
        most = self.texts.index(max(self.texts))
        out = []
        for i in range(len(texts)):
            if not letters[i]:
                out.append(("und", 0.0))
            elif summed[i] <= 0:
                out.append((self.languages[most], 0.0))
            else:
                out.append((self.languages[best[i]], float(counts[best[i], i] / summed[i])))
        return out


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > TOGETHER:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, min_share: float = MIN_SHARE) -> Model:
    """The model of ``labelled`` (doc_id, text, lang; rows with a null lang are left out)."""
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    workers_see_package(labelled.sparkSession)
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    chosen = labelled.where((F.xxhash64("doc_id", "text").cast("double") / 2.0**63 + 1) / 2 < share)
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            langs, texts = part.column("lang").to_pylist(), as_text(part.column("text"))
            for lang in sorted(set(langs)):
                own = [t for t, g in zip(texts, langs, strict=True) if g == lang]
                seen = []
                for a, b in _groups(own):
                    code, owner, _ = grams(own[a:b])
                    pairs = np.unique(np.stack([owner.astype(np.uint64), code]), axis=1)[1]
                    seen.append(pairs)
                codes, n = np.unique(np.concatenate(seen), return_counts=True)
                yield record_batch(schema, [lang] * len(codes), codes.view(np.int64), n)

    counted = chosen.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    texts = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    least = F.lit(2.0)
    for lang, n in texts.items():
        least = F.when(F.col("lang") == lang, max(2.0, min_share * n)).otherwise(least)
    # at most (n-grams of a text) / min_share for each language
    kept = counted.where(F.col("n") >= least).groupBy("lang").agg(F.collect_list("code").alias("codes")).collect()
    found = [(languages.index(r["lang"]), np.array(r["codes"], np.int64).view(np.uint64)) for r in sorted(kept, key=lambda r: r["lang"])]
    return Model(languages, [sizes[x] for x in languages], found)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs`` (doc_id, held_out, text)."""
    spark = docs.sparkSession
    workers_see_package(spark)
    shipped = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for part in slices(batches):
            texts = as_text(part.column("text"))
            said = [x for a, b in _groups(texts) for x in own.predict(texts[a:b])]
            yield record_batch(schema, part.column("doc_id"), part.column("held_out"), [x[0] for x in said], [x[1] for x in said])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 4))
    return identify(docs, fit(docs.where("not held_out")))
