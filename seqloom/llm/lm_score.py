"""LM scoring: a causal self-attention model on subword ids over counts of all training texts, beside a unigram base over words.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, and a text ends with one end token. Base scores need the count of every word in
all training texts: tasks count words, a shuffle sums them, the most frequent (at most ``FREQUENT``) are broadcast and
the other words of a text are joined with their counts. Nothing is sampled or capped there, and words of any frequency count.

The model (see ``lm_model``) reads byte-level BPE ids of the words, each with a space before it, and the end, so it is a distribution
over word sequences. Its counts of ids inside words come from all words of all training texts; the ``GRAMS`` most frequent are
broadcast, and what is left out is known as a sum. The classes of ids come from counts of the ids beside them in all training texts.
The attention is fitted on all training texts, whole and where they lie: hashes deal them to ``ROUNDS`` rounds, in each a task improves
the parameters on its part, and the mean of all tasks' parameters, weighted by windows, begins the next round, so each window is
seen once. Only where the first round begins comes from a bounded sample, a stretch of at most ``STRETCH`` bytes from each of about
``SAMPLE_TEXTS`` training texts. Long texts are scored in windows whose first part is context only, so each id is scored once.

Null and empty texts have just the end token. With no training text at all, N and V are 0, base scores use 1 / (0 + 0 + 1), and the
model is untrained. Rows with equal or null ids stay rows of their own; samples are drawn by hashes of id and text, of rows that are
equal in both the driver takes one. Other columns are ignored. Very long texts are scored whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import count, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import lm_model
from seqloom.llm.common import as_bytes, held_out, most_frequent, record_batch, slices, stored, table, workers_see_package
from seqloom.llm.lm_model import CACHE_WORDS, RECORD, STEPS, Model, Prior

FREQUENT, TASK_WORDS, GRAMS, GRAM_WORDS = 200_000, 250_000, 400_000, 200_000
SAMPLE_TEXTS, STRETCH = 1_500, 4_000
#: Rounds of the distributed fit, to which all training texts are dealt, and ids that a task fits together.
ROUNDS, FIT_RATE, FIT_IDS = 3, 0.003, 400_000
END = b""  # no word is empty


# Counting


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary; the end token is empty), c over all of ``docs`` (text)."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts: Counter = Counter()
        for part in slices(batches):
            for text in as_bytes(part.column(0)):
                counts.update(text.lower().split())
                counts[END] += 1
            if len(counts) > TASK_WORDS:
                yield record_batch(schema, list(counts), list(counts.values()))
                counts.clear()
        if counts:
            yield record_batch(schema, list(counts), list(counts.values()))

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def mark(word: bytes) -> bytes:
    """The word, or a digest of a long one: what the broadcast table holds."""
    return word if len(word) <= 64 else b"\0" + hashlib.md5(word).digest()


def gram_table(counts: DataFrame, path: str) -> DataFrame:
    """context, following, n: ids inside words (see ``lm_model.gram_counts``) of texts whose words have these ``counts`` (word, c)."""
    schema = pa.schema([("context", pa.int64()), ("following", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        end = lm_model.subwords(path).n_vocab
        held, sizes = [], []

        def counted() -> pa.RecordBatch:
            context, following, n = lm_model.gram_counts([ids for part in held for ids in part], np.concatenate(sizes), end)
            return record_batch(schema, context.view(np.int64), following, n)

        for part in slices(batches, 50_000):
            held.append(lm_model.encode(part.column("word").to_pylist(), path))
            sizes.append(part.column("c").to_numpy())
            if sum(map(len, sizes)) > GRAM_WORDS:  # many words together, as they share most of what stands in them
                yield counted()
                held, sizes = [], []
        if sizes:
            yield counted()

    return counts.where(F.octet_length("word") > 0).select("word", "c").mapInArrow(run, "context long, following int, n long").groupBy("context", "following").agg(F.sum("n").alias("n"))


def neighbours(learned: DataFrame, top: np.ndarray, path: str) -> tuple[np.ndarray, int]:
    """How often each id has each of the ids ``top`` beside it in all texts ``learned``, and the number of pairs (see ``lm_model.Neighbours``).

    A task sums what it meets, a shuffle by id sums the tasks'; the driver gets a row of ``lm_model.MET`` counts for each id.
    """
    size = len(lm_model.starts_of(path))
    schema = pa.schema([("id", pa.int32()), ("place", pa.binary()), ("n", pa.binary()), ("pairs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        coded, met, held = Coded(path), lm_model.Neighbours(top, size), []

        def taken() -> pa.RecordBatch:
            own, place, n, pairs = met.taken()
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else own
            places, counts, ends = place.astype(np.uint8), n.astype(np.int32), [*first[1:], len(own)]
            parts = list(zip(first.tolist(), ends, strict=False))
            return record_batch(schema, [*own[first].tolist(), size - 1], [*(places[a:b].tobytes() for a, b in parts), b""], [*(counts[a:b].tobytes() for a, b in parts), b""], [0] * len(parts) + [pairs])

        for part in slices(batches, 64):
            held += coded.of([t.lower().split() for t in as_bytes(part.column("text"))])[0]
            if sum(map(len, held)) > FIT_IDS:
                met.add(held)
                held = []
            if met.pairs > 1 << 30:  # a count stays below 2 ** 31, as a slice of 64 texts has far fewer pairs
                yield taken()
        met.add(held)
        yield taken()

    summed = pa.schema([("id", pa.int32()), ("n", pa.binary()), ("pairs", pa.int64())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}
        pairs = 0
        for part in slices(batches):
            for own, place, n, more in zip(*(c.to_pylist() for c in part.columns), strict=True):
                pairs += more
                if n:
                    if own not in rows:
                        rows[own] = np.zeros(lm_model.MET, np.int64)
                    rows[own][np.frombuffer(place, np.uint8)] += np.frombuffer(n, np.int32)
        yield record_batch(summed, [*rows, size - 1], [*(x.astype(np.float32).tobytes() for x in rows.values()), b""], [0] * len(rows) + [pairs])

    got = learned.select("text").mapInArrow(count, "id int, place binary, n binary, pairs long").repartition("id").mapInArrow(merge, "id int, n binary, pairs long").toArrow()
    around = np.zeros((size, lm_model.MET), np.float32)
    for batch in got.to_batches():
        for own, n in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if n:
                around[own] = np.frombuffer(n, np.float32)
    return around, sum(got.column("pairs").to_pylist())


def prior(counts: DataFrame, learned: DataFrame, texts: int, path: str, seed: int) -> Prior:
    """The prior of the training texts ``learned`` (text) with these word ``counts``; the driver gets counts of single ids and bounded tables."""
    grams = stored(gram_table(counts, path), "grams")
    starts = lm_model.starts_of(path)
    singles = (np.zeros(len(starts)), np.zeros(len(starts)))
    for r in grams.where("context in (0, 1)").collect():  # a row for each id
        singles[r["context"]][r["following"]] = r["n"]
    met = singles[0] + singles[1]
    met[-1] = 0  # the end is beside no id
    label = lm_model.clusters(*neighbours(learned, lm_model.most_met(met), path), met, starts, np.random.default_rng(seed))
    inner = grams.where("context not in (0, 1)")
    kept = most_frequent(inner, "n", GRAMS)
    # all followers of a context are ids, so a list is at most the vocabulary
    lists = inner.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("different"), F.collect_list(F.when(kept, F.struct("following", "n"))).alias("kept"))
    rows = lists.where("size(kept) > 0").select("context", "total", "different", F.col("kept.following").alias("following"), F.col("kept.n").alias("n")).toArrow()
    columns = [rows.column("context").to_numpy().view(np.uint64), rows.column("total").to_numpy(), rows.column("different").to_numpy(), rows.column("following").to_pylist(), rows.column("n").to_pylist()]
    return Prior(starts, label, texts, singles, list(zip(*columns, strict=True)))


# Words of a worker


class Known:
    """Words with a number each: what is known of their ids, one behind the other, and the logarithms of their counts. Number 0, the empty word, is the end."""

    def __init__(self, end: np.ndarray, left: Known | None = None) -> None:
        """``left``, which isn't used any more, gives its room."""
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)  # a word that is met for the first time gets the next
        self.plain = np.dtype((np.void, end.dtype.itemsize))  # numpy copies what has no fields faster
        self.records, self.used = left.records if left else np.empty(1 << 16, end.dtype), 0
        self.begin, self.size, self.log = (left.begin, left.size, left.log) if left else (np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14))
        self.number[END]
        self.put(np.zeros(1, np.int64), end, np.array([len(end)]), np.zeros(1))

    def numbers(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """The number of each word, and the words that had none, in the order of their numbers, the last; ``put`` must follow for these."""
        had = len(self.number)
        out = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        return out, list(islice(reversed(self.number), len(self.number) - had))[::-1]

    def put(self, numbers: np.ndarray, records: np.ndarray, sizes: np.ndarray, logs: np.ndarray) -> None:
        most, used = len(self.number), self.used + len(records)
        if used > len(self.records):
            room = np.empty(used + (used >> 1), self.records.dtype)
            room.view(self.plain)[: self.used] = self.records.view(self.plain)[: self.used]
            self.records = room
        if most > len(self.begin):
            self.begin, self.size, self.log = (np.concatenate([x, np.zeros(most + (most >> 1) - len(x), x.dtype)]) for x in (self.begin, self.size, self.log))
        self.records.view(self.plain)[self.used : used] = records.astype(self.records.dtype, copy=False).view(self.plain)
        self.begin[numbers], self.size[numbers], self.log[numbers] = self.used + np.cumsum(sizes) - sizes, sizes, logs
        self.used = used

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The records of these words one behind the other, and the words' sizes."""
        sizes = self.size.take(numbers)
        ends = np.cumsum(sizes)
        at = np.repeat(self.begin.take(numbers) - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.records.take(at), sizes


class Generations:
    """Words that a worker knows, in two generations: words that are met again stay when the older one goes."""

    def __init__(self, end: np.ndarray, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.end, self.learn = end, learn
        self.young, self.old = Known(end), Known(end)

    def of(self, texts: list[list[bytes]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each text (its words): what is known of all ids and the end, and the logarithm of each word."""
        if len(self.young.number) > CACHE_WORDS:
            self.young, self.old = Known(self.end, self.old), self.young
        words: list[bytes] = []
        for t in texts:
            words += t
            words.append(END)
        numbers, fresh = self.young.numbers(words)
        if fresh:
            own = np.arange(len(self.young.number) - len(fresh), len(self.young.number))
            before = self.old.find(fresh)
            known = before >= 0
            self.young.put(own[known], *self.old.take(before[known]), self.old.log[before[known]])
            if not known.all():
                self.young.put(own[~known], *self.learn([fresh[i] for i in np.flatnonzero(~known).tolist()]))
        records, sizes = self.young.take(numbers)
        logs = self.young.log.take(numbers)
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        places = np.cumsum(sizes)[ends - 1] if len(texts) else ends
        return [records[a:b] for a, b in zip([0, *places.tolist()], places.tolist(), strict=False)], [logs[b - len(t) - 1 : b - 1] for t, b in zip(texts, ends.tolist(), strict=True)]


class Coded(Generations):
    """Ids of words."""

    def __init__(self, path: str) -> None:
        def learn(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids, sizes = lm_model.coded(words, path)
            return ids, sizes, np.zeros(len(words))

        super().__init__(np.zeros(0, np.uint16), learn)  # the end is beside no id


class Words(Generations):
    """What a worker knows of words: their ids with the prior (``RECORD``), and log10(count + 1) where they are frequent, else -1."""

    def __init__(self, prior_: Prior, path: str, frequent: dict[bytes, float]) -> None:
        def learn(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            records, offsets = prior_.flat_records(lm_model.coded(words, path))
            return records, np.diff(offsets), np.fromiter(map(frequent.get, map(mark, words) if max(map(len, words)) > 64 else words, repeat(-1.0)), float, len(words))

        super().__init__(np.frombuffer(prior_.end_record(), RECORD), learn)
        self.prior = prior_


_words: dict[str, Words] = {}


def worker_words(key: str, *made) -> Words:
    """One for each process and run, so that tasks share it."""
    if key not in _words:
        _words.clear()
        _words[key] = Words(*made)
    return _words[key]


def forget() -> None:
    """Frees the words of a former run; tasks that come before a model call it."""
    _words.clear()


# Fitting


def drawn(docs: DataFrame, rate: float, salt: int) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) whose hash of id and text lies in the first ``rate`` of all hashes."""
    most = min((1 << 63) - 1, int((2 * min(1.0, rate) - 1) * (1 << 63)))
    return docs.where(F.xxhash64(F.lit(salt), "doc_id", "text") <= F.lit(most))


def warm_start(learned: DataFrame, texts: int) -> list[bytes]:
    """Stretches of a bounded sample of texts, each once, at places that a hash chooses."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    sample = drawn(learned, SAMPLE_TEXTS / max(1, texts), 0).select(text.alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    at = F.pmod(F.col("h"), F.greatest(F.lit(1), F.octet_length("text") - STRETCH + 1)).cast("int")
    rows = sample.select("h", F.substring("text", at + 1, F.lit(STRETCH)).alias("text")).groupBy("h").agg(F.min("text").alias("text"))
    return [bytes(r["text"]) for r in sorted(rows.collect(), key=lambda r: r["h"])]


def fitted(model: Model, learned: DataFrame, path: str, key: str, rounds: int, frequent: dict[bytes, float]) -> Model:
    """The model after ``rounds`` rounds, which share all of ``learned``; nothing but means of parameters reaches the driver."""
    spark = learned.sparkSession
    names = sorted(model.p)
    schema = pa.schema([("k", pa.int32()), ("total", pa.float64()), ("n", pa.float64())])
    known = spark.sparkContext.broadcast((model.prior, frequent))
    for turn in range(rounds):
        shipped = spark.sparkContext.broadcast(model.p)

        def improve(batches: Iterator[pa.RecordBatch], shipped=shipped, turn=turn) -> Iterator[pa.RecordBatch]:
            prior_, tier = known.value
            words = worker_words(key, prior_, path, tier)
            own, rng, seen, held = Model(words.prior, {k: v.copy() for k, v in shipped.value.items()}), np.random.default_rng(turn), 0, []
            for part in slices(batches, 64):
                held += words.of([t.lower().split() for t in as_bytes(part.column("text"))])[0]
                if sum(map(len, held)) > FIT_IDS:
                    seen += own.fit(held, rng, rate=FIT_RATE)
                    held = []
            seen += own.fit(held, rng, rate=FIT_RATE)
            if seen:
                flat = np.concatenate([own.p[k].reshape(-1) for k in names]).astype(float)
                yield record_batch(schema, np.arange(len(flat), dtype=np.int32), flat * seen, np.full(len(flat), float(seen)))

        part = learned.where(F.pmod(F.xxhash64(F.lit(1), "doc_id", "text"), F.lit(rounds)) == turn).select("text")
        means = part.mapInArrow(improve, "k int, total double, n double").groupBy("k").agg((F.sum("total") / F.sum("n")).alias("v"), F.sum("n").alias("n"))
        rows = means.orderBy("k").toArrow()
        shipped.unpersist()
        if not rows.num_rows:
            continue  # no text in this round
        model.windows += int(rows.column("n")[0].as_py())
        flat, at = rows.column("v").to_numpy().astype(np.float32), 0
        for k in names:
            shape = model.p[k].shape
            model.p[k] = flat[at : at + model.p[k].size].reshape(shape).copy()
            at += model.p[k].size
    known.unpersist()
    return model


def model_of(learned: DataFrame, counts: DataFrame, texts: int, path: str, key: str, steps: int = STEPS, rounds: int = ROUNDS, seed: int = 0, frequent: dict[bytes, float] | None = None) -> Model:
    """The model of the training texts ``learned`` (doc_id, text), whose words have ``counts``; ``frequent`` is for workers' words."""
    own = prior(counts, learned, texts, path, seed)
    rng = np.random.default_rng(seed)
    model = Model(own, lm_model.init(rng))
    if not texts:
        return model
    sample = [t.lower().split() for t in warm_start(learned, texts)]
    model.fit(Words(own, path, {}).of(sample)[0], rng, steps)
    return fitted(model, learned, path, key, rounds, frequent or {})


# Scoring


def score(docs: DataFrame, path: str, steps: int = STEPS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs`` (doc_id, text, held_out)."""
    spark = docs.sparkSession
    workers_see_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    learned = docs.where("not held_out")
    counts = stored(word_counts(learned), "word-counts")
    total, distinct, texts = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col("c"))), F.lit(0))).first()
    rows = counts.where(most_frequent(counts, "c", FREQUENT)).toArrow()
    frequent = {mark(w): float(np.log10(c + 1)) for w, c in zip(rows.column("word").to_pylist(), rows.column("c").to_pylist(), strict=True)}
    key = uuid.uuid4().hex  # workers that are used again must not take one model for another
    model = model_of(learned, counts, texts, path, key, steps, rounds, frequent=frequent)
    shipped = spark.sparkContext.broadcast((model, frequent))
    end_log = frequent.get(END, -1.0)
    rare = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("known", pa.float64()), ("score", pa.float64()), ("rare", rare)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, tier = shipped.value
        words = worker_words(key, own.prior, path, tier)
        row = TaskContext.get().partitionId() << 33
        for part in slices(batches, 64):
            texts = [t.lower().split() for t in as_bytes(part.column("text"))]
            coded, logs = words.of(texts)
            n_known, known, left = [], [], []
            for found, log in zip(texts, logs, strict=True):
                rare_at = np.flatnonzero(log < 0)
                more = Counter([found[i] for i in rare_at.tolist()])
                n_known.append(len(found) - len(rare_at) + (end_log >= 0))
                known.append(float(log.sum()) + len(rare_at) + max(0.0, end_log))
                if end_log < 0:
                    more[END] += 1
                left.append([{"word": w, "n": n} for w, n in more.items()])
            rows = range(row, row + len(coded))
            row += len(coded)
            yield record_batch(schema, rows, part.column("doc_id"), part.column("held_out"), [len(t) + 1 for t in texts], n_known, known, own.score(coded), left)

    scored = stored(docs.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, known double, score double, rare array<struct<word: binary, n: long>>"), "scored")
    rest = scored.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
    rest = rest.join(counts, "word").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("log"))
    out = scored.drop("rare").join(rest, "row", "left")
    base = F.col("known") + F.coalesce("log", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text", held_out(F.col("doc_id"), 7).alias("held_out")), public_tokenizers.path("byte_bpe_50k.tiktoken"))
