"""Periodic runs of words in texts, found with a run-length grammar.

Words are ``[^\\x20\\x09-\\x0D]+`` as they stand (letter case counts). A run is a maximal stretch of words with smallest period q and
a length of at least ``max(LEAST, TIMES * q)``. Words a period apart are equal in at least ``max(LEAST - q, (TIMES - 1) * q)``
places in a row, so a grid of that step has a place in every run of period q. All these places for all periods of a text are n log n
in number; where the words a period apart are equal there, two common extensions in the grammar (``grammar.py``) give the exact ends. A stretch found with
several periods is one run with the smallest: the others are multiples of it, as three periods fit in.

Many texts share one grammar, each behind a word of its own that occurs nowhere else, so no extension leaves its text; a task holds
texts of about ``BATCH`` words, or one longer text, at a time. Long texts are searched in parts of at most ``PLACES`` grid places.

Null, empty and blank texts have no words and no runs. Equal rows get equal results, other columns are ignored, and an empty table
gives an empty result. In ``op11_periodic_runs`` a row with a null id keeps its words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import as_bytes, record_batch, table, workers_see_package
from seqloom.llm.grammar import Grammar

LEAST, TIMES = 24, 3
#: Words of the texts that share a grammar; grid places looked at together; known runs that keep places inside them from being looked at again.
BATCH, PLACES, KNOWN = 1 << 17, 1 << 20, 64


def grid(n: int, least: int = LEAST, times: int = TIMES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places x and periods q for ``n`` words, in parts with growing periods: each run of period q has a grid place x in it, x + q too."""
    periods = np.arange(1, n // times + 1 if n >= least else 1)
    steps = np.maximum(least - periods, (times - 1) * periods)
    sizes = (n - periods) // steps
    periods, steps, sizes = (a[sizes > 0] for a in (periods, steps, sizes))
    part = (np.cumsum(sizes) - sizes) // PLACES
    for cut in np.split(np.arange(len(periods)), np.flatnonzero(np.diff(part)) + 1):
        if len(cut):
            size = sizes[cut]
            k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            yield (k + 1) * np.repeat(steps[cut], size) - 1, np.repeat(periods[cut], size)


def _known(x: np.ndarray, q: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Places whose extension is known: inside a run, by a multiple of its period."""
    inside = np.zeros(len(x), bool)
    for start, end, period in runs[np.argsort(runs[:, 0] - runs[:, 1], kind="stable")[:KNOWN]]:
        inside |= (x >= start) & (x + q < end) & (q % period == 0)
    return inside


def _merged(runs: np.ndarray) -> np.ndarray:
    """Rows start, end, period, each stretch once with its smallest period, by start, then period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))[: len(runs)]
    runs = runs[fresh]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """The runs of each text, given as an array of word numbers (0 and up): rows start, end (exclusive), period."""
    top = max((int(t.max()) + 1 for t in texts if len(t)), default=0)
    marks = np.arange(top, top + len(texts) + 1)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts]) + 1
    joined = np.concatenate([p for k, t in enumerate(texts) for p in (marks[k : k + 1], t)] + [marks[-1:]])
    grammar = Grammar(joined)
    parts = [grid(len(t), least, times) for t in texts]
    found = [np.zeros((0, 3), np.int64) for _ in texts]
    live = list(range(len(texts)))
    while live:
        xs, qs, of, going = [], [], [], []
        for k in live:
            part = next(parts[k], None)
            if part is None:
                continue
            going.append(k)
            x, q = part
            equal = texts[k][x] == texts[k][x + q]
            x, q = x[equal], q[equal]
            if len(found[k]):
                new = ~_known(x, q, found[k])
                x, q = x[new], q[new]
            xs.append(x)
            qs.append(q)
            of.append(np.full(len(x), k))
        live = going
        if not live:
            break
        x, q, of = np.concatenate(xs), np.concatenate(qs), np.concatenate(of)
        at = x + starts[of]
        start, end = x - grammar.backward(at, at + q), x + q + grammar.forward(at, at + q)
        enough = end - start >= np.maximum(least, times * q)
        start, end, q, of = (a[enough] for a in (start, end, q, of))
        for k in np.unique(of):
            mine = of == k
            found[k] = _merged(np.concatenate([found[k], np.stack([start[mine], end[mine], q[mine]], axis=1)]))
    return found


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` words stays when every run is cut to its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """start, end, period with the greatest exact length / period; ties: smallest start, then period."""
    return min(map(tuple, runs.tolist()), key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)


def _repeating(doc_id: int | None, n: int) -> np.ndarray | None:
    """For every tenth id or so, the word that stands at each place of the text when its end is made periodic."""
    if doc_id is None or not n:
        return None
    h = crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _batches(batches: Iterator[pa.RecordBatch], planted: bool) -> Iterator[tuple[list, list[list[bytes]], list[np.ndarray]]]:
    """Ids, words and runs of texts that share a grammar."""
    ids, words, size = [], [], 0

    def searched():
        names: dict[bytes, int] = defaultdict(count().__next__)
        numbers = [np.fromiter(map(names.__getitem__, w), np.int64, len(w)) for w in words]
        long = [k for k, w in enumerate(numbers) if len(w) >= LEAST]
        runs = [np.zeros((0, 3), np.int64)] * len(words)
        if long:
            for k, r in zip(long, runs_of([numbers[k] for k in long]), strict=True):
                runs[k] = r
        return ids, words, runs

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for doc_id, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
                w = text.split()
                order = _repeating(doc_id, len(w)) if planted else None
                if order is not None:
                    w = [w[i] for i in order.tolist()]
                if words and size + len(w) > BATCH:
                    yield searched()
                    ids, words, size = [], [], 0
                ids.append(doc_id)
                words.append(w)
                size += len(w)
    if words:
        yield searched()


def _chosen(docs: DataFrame, id_column: str) -> DataFrame:
    workers_see_package(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def runs(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """doc_id, runs (array of start, length, period by start, then period), collapsed (the text's words, joined by one space, each run cut to its first period)."""
    out = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, found in _batches(batches, False):
            rows = [[{"start": s, "length": e - s, "period": q} for s, e, q in r.tolist()] for r in found]
            texts = [b" ".join([w[i] for i in np.flatnonzero(kept_words(len(w), r)).tolist()] if len(r) else w).decode("utf-8", "replace") for w, r in zip(words, found, strict=True)]
            yield record_batch(out, ids, rows, texts)

    return _chosen(docs, id_column).mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digests(docs: DataFrame, planted: bool = False) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the strongest run, runs_sha256, collapsed_sha256.

    ``planted``: the ends of about a tenth of the texts, chosen by id, are made periodic first.
    """
    numbers = ["n_runs", "start", "length", "period", "exponent_milli"]
    out = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in numbers] + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, found in _batches(batches, planted):
            rows = []
            for w, r in zip(words, found, strict=True):
                best = strongest(r)
                first = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
                listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in r.tolist())
                kept = [w[i] for i in np.flatnonzero(kept_words(len(w), r)).tolist()] if len(r) else w
                rows.append((len(r), *first, sha256(listed.encode()).hexdigest(), sha256(b" ".join(kept)).hexdigest()))
            yield record_batch(out, ids, *(list(c) for c in zip(*rows, strict=True)))

    return _chosen(docs, "doc_id").mapInArrow(run, ", ".join(["doc_id long"] + [f"{c} long" for c in numbers] + ["runs_sha256 string", "collapsed_sha256 string"]))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), planted=True)
