"""Benchmark decontamination with a distributed positional inverted index.

Documents and items are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. The anchor of a window is its
rarest word by document frequency over all documents. The index holds postings of the words of a window for each document that
has the anchor and then all other words of the window, in whatever places; other documents cannot hold the phrase. A window's occurrences are found from its anchor's postings outwards: the
postings of the next rarest word, moved by its offset in the window, are intersected with the starts found so far, until all
words of the window agree; what is left are exact phrase matches. ``proximity`` intersects postings by distance instead.

The benchmark's windows are broadcast only while they have at most ``BROADCAST_WORDS`` words together; beyond that every word is
indexed and the restriction is a join. So the stored index serves the given windows, not any later query: for phrases that are not
known beforehand ``positional_index`` takes None and stores the postings of all words.

Null and empty texts have no words; an item without words has no window; repeated rows (same id and text) get the same result, null
ids are kept, rarity ties go to the word that sorts first, other columns are ignored; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.common import as_bytes, record_batch, slices, stored, table, workers_see_package

WINDOW = 13
#: A document is contaminated if at least one word in this many is hit.
SHARE = 20
#: Words of all windows together that may be broadcast (a few dozen MB).
BROADCAST_WORDS = 1_000_000
TASK_WORDS = 200_000
#: ASCII letters lowered, digits and all bytes from 0x80 kept, the rest turned into spaces.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def row_key(docs: DataFrame) -> Column:
    """Names a row by its id and text (16 bytes), so that rows that share an id are told apart at any number of rows.

    A digest of the id in digits, a mark for a null text and the text, so rows share a key only if id and text are the same.
    """
    return F.unhex(F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.coalesce(F.concat(F.lit(":"), docs["text"]), F.lit("."))).cast("binary")))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def item_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """item_id, window (its words, joined), len, off, word: one row for each word of each window."""
    spaced = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", " ")
    ascii_lower = F.translate(spaced, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = benchmark.select("item_id", F.filter(F.split(ascii_lower, " "), lambda w: w != "").alias("w")).where("size(w) > 0")
    items = items.withColumn("len", F.least(F.size("w"), F.lit(width)))
    windows = items.select("item_id", "len", F.explode(F.expr("transform(sequence(0, size(w) - len), i -> slice(w, i + 1, len))")).alias("ws"))
    return windows.select("item_id", F.array_join("ws", " ").alias("window"), "len", F.posexplode("ws").alias("off", "word"))


def document_frequency(docs: DataFrame, vocabulary) -> DataFrame:
    """word, df over all documents, for the words of the broadcast ``vocabulary`` (all words where it is None)."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value if vocabulary else None
        counts: Counter = Counter()
        for part in slices(batches):
            for text in as_bytes(part.column(0)):
                counts.update(known.intersection(words(text)) if known is not None else set(words(text)))
            if len(counts) > TASK_WORDS and known is None:
                yield record_batch(schema, list(counts), list(counts.values()))
                counts.clear()
        yield record_batch(schema, list(counts), list(counts.values()))

    counted = docs.select("text").mapInArrow(count, "word binary, n long")
    return counted.groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("df"))


def positional_index(docs: DataFrame, anchored) -> DataFrame:
    """key, doc_id, n_words, postings (word, positions): one row for each document.

    ``anchored`` is a broadcast map from an anchor to the word sets of its windows; with None, postings are of all words.
    """
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("postings", pa.list_(pa.struct([("word", pa.string()), ("positions", pa.list_(pa.int32()))])))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = anchored.value if anchored else None
        anchors = frozenset(windows or ())
        for part in slices(batches):
            sizes, postings = [], []
            for text in as_bytes(part.column("text")):
                found = words(text)
                sizes.append(len(found))
                if windows is None:
                    sought = set(found)
                else:
                    own = set(found)
                    sought = set().union(*(w for a in anchors & own for w in windows[a] if w <= own))
                if not sought:
                    postings.append(None)
                    continue
                at: dict[bytes, list[int]] = {}
                for i, w in enumerate(found):
                    if w in sought:
                        at.setdefault(w, []).append(i)
                postings.append([{"word": w.decode("utf-8", "replace"), "positions": p} for w, p in at.items()])
            yield record_batch(schema, part.column("key"), part.column("doc_id"), sizes, postings)

    keyed = docs.select(row_key(docs).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return keyed.mapInArrow(build, "key binary, doc_id long, n_words long, postings array<struct<word: string, positions: array<int>>>")


def phrase_matches(windows: DataFrame, postings: DataFrame) -> DataFrame:
    """key, window, len, start of every occurrence: offset-adjusted lists, intersected from the rarest word on.

    ``windows`` has window, len, off, word, rank (1 for the rarest); ``postings`` has key, word, pos.
    """
    anchors = windows.where("rank = 1").select("window", "len", "off", "word")
    starts = anchors.join(postings, "word").where("pos >= off").select("key", "window", "len", (F.col("pos") - F.col("off")).alias("start"))
    rest = starts.join(windows.where("rank > 1").select("window", "off", "word"), "window").select("key", "window", "start", "word", (F.col("start") + F.col("off")).alias("pos"))
    agreed = rest.join(postings, ["key", "word", "pos"]).groupBy("key", "window", "start").agg(F.count("*").alias("n"))
    return starts.join(agreed, ["key", "window", "start"], "left").where("len = coalesce(n, 0) + 1").select("key", "window", "len", "start")


def proximity(postings: DataFrame, left: str, right: str, within: int) -> DataFrame:
    """key, left_pos, right_pos of the places where two words stand at most ``within`` words apart, in either order."""
    a = postings.where(F.col("word") == left).select("key", F.col("pos").alias("left_pos"))
    b = postings.where(F.col("word") == right).select("key", F.col("pos").alias("right_pos"))
    cell = lambda c: F.floor(F.col(c) / within)
    a = a.withColumn("cell", F.explode(F.array(cell("left_pos") - 1, cell("left_pos"), cell("left_pos") + 1)))
    return a.join(b.withColumn("cell", cell("right_pos")), ["key", "cell"]).where(F.abs(F.col("left_pos") - F.col("right_pos")) <= within).drop("cell").where("left_pos <> right_pos")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: int = SHARE) -> DataFrame:
    """key (see ``row_key``), doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``."""
    spark = docs.sparkSession
    workers_see_package(spark)
    windows = stored(item_windows(benchmark, width).withColumn("window", F.xxhash64("window", "len")), "windows")
    used = windows.select("word").distinct()
    distinct = windows.select("window", "len", "off", "word").distinct()
    few = distinct.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    vocabulary = spark.sparkContext.broadcast(frozenset(r["word"].encode() for r in used.toLocalIterator())) if few else None
    frequency = document_frequency(docs, vocabulary)
    by_rarity = W.partitionBy("window").orderBy(F.coalesce("df", F.lit(0)), "word", "off")
    ranked = stored(distinct.join(frequency, "word", "left").withColumn("rank", F.row_number().over(by_rarity)).drop("df"), "ranked")
    anchored = None
    if few:
        sets: dict[bytes, set[frozenset[bytes]]] = {}
        for r in ranked.groupBy("window").agg(F.max(F.when(F.col("rank") == 1, F.col("word"))).alias("anchor"), F.collect_set("word").alias("ws")).toLocalIterator():
            sets.setdefault(r["anchor"].encode(), set()).add(frozenset(w.encode() for w in r["ws"]))
        anchored = spark.sparkContext.broadcast(sets)
    index = stored(positional_index(docs, anchored), "index")
    lists = index.where("postings is not null").select("key", F.explode("postings").alias("p")).select("key", F.col("p.word").alias("word"), F.explode("p.positions").alias("pos"))
    if not few:
        lists = lists.join(used, "word", "left_semi")
    found = stored(phrase_matches(ranked, lists.distinct()), "matches")
    order = W.partitionBy("key").orderBy("start", "stop")
    spans = found.select("key", "start", (F.col("start") + F.col("len")).alias("stop")).distinct()
    spans = spans.withColumn("before", F.coalesce(F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    hits = spans.groupBy("key").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "before"))).alias("n_hit"))
    items = found.select("key", "window").distinct().join(windows.select("window", "item_id").distinct(), "window")
    items = items.select("key", F.col("item_id").cast("string").alias("item")).distinct().groupBy("key")
    items = items.agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_set("item")), ",").alias("items"))
    out = index.select("key", "doc_id", "n_words").join(hits, "key", "left").join(items, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("key", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP9_SQL = f"""
WITH iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
il AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM il)),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, dwin.n, item_id FROM dwin JOIN win USING (win, n)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
