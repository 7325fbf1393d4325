"""Quality rules: robust multivariate outliers by minimum covariance determinant, in DataFrame expressions only.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. The base rule fails texts with fewer than ``MIN_WORDS`` words or with more than
half of their words in repeated 3-word windows. Five transformed statistics (see ``STATS``) of the texts that pass are then held
against robust estimates of centre and covariance, one for each language and source. Three starts about the coordinate-wise
medians (quartiles, tanh of the standardized statistics, their spatial signs) take concentration steps, each fitting mean and
covariance on the share ``SUPPORT`` of texts that are nearest by the last estimate, until no determinant moves or for ``STEPS``
steps; the start with the smallest determinant is kept, the first of those within ``TIE``. Texts whose squared Mahalanobis
distance passes ``CUT``, the 0.999 quantile of chi-square, are rejected.

Orders within a group come from counts over bins of a fixed grid, so a group of any size is a few hundred rows in the shuffle
and every step is an aggregate that combines in the map. Groups with fewer than ``MIN_GROUP`` passing texts use the estimate
pooled over all groups. ``FLOORS`` and ``LINE_FLOOR`` are added to the scale of each statistic. Most texts have no symbols, repeats
or duplicate lines, so their rates have no spread among the nearest texts; there the floor is the noise of counting, so that a
single chance repeat rejects no text, while each rate can still reject by itself. Null and empty texts have no words and fail the base rule; null languages and sources
form groups of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.common import stored, table

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Statistics: log mean word length, log number of different words against log words, root symbol rate, root repeat rate, root
#: rate of duplicate lines.
STATS = ("x0", "x1", "x2", "x3", "x4")
#: Floors of x0 to x3 and of x4. The first two are numeric; the noise of a root rate over n trials is 0.5 / sqrt(n), here of 250
#: characters and 50 words (the shortest text that passes) and of 25 lines.
FLOORS, LINE_FLOOR = (0.001, 0.001, 0.0316, 0.0707), 0.1
#: Groups whose estimates (a few hundred bytes each) may be broadcast; with more, Spark joins by group.
BROADCAST_GROUPS = 20_000
#: CUT is the 0.999 quantile of chi2_5.
SUPPORT, STEPS, MIN_GROUP, CUT = 0.75, 12, 200, 20.515
#: Makes the covariance of the nearest 75 % consistent for five normal variables: 0.75 / P(chi2_7 <= q_0.75(chi2_5)).
CONSISTENCY = 1.412
#: Log determinants this near are equal: the edge of the nearest texts is known to a bin of 2 % only. The last steps may still move
#: them by less than that.
TIE = 0.05
#: Steps after which the driver asks whether a determinant still moves; a step that moves none leaves the estimates as they are.
LOOK = 4
#: Bins to a unit of a statistic, and to a factor of e of a distance.
GRID, DISTANCE_GRID = 200, 50
PAIRS = [(i, j) for i in range(len(STATS)) for j in range(i + 1)]
_COUNTS = """
named_struct(
  'n_words', cast(size(w) as long),
  'word_chars', cast(length(array_join(w, '')) as long),
  'n_symbols', cast(regexp_count(t, '[#*$%&|<>]') as long),
  'n_dup_lines', cast(size(l) - size(array_distinct(l)) as long),
  'n_lines', cast(size(l) as long),
  'n_repeat_words', aggregate(sort_array(r), named_struct('n', 0L, 'to', 0), (a, i) -> named_struct('n', a.n + i + 3 - greatest(a.to, i), 'to', i + 3), a -> a.n),
  'n_distinct', cast(size(array_distinct(w)) as long))
"""


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text: n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_distinct.

    A repeated window is found by sorting the windows' hashes within the row, so nothing is shuffled.
    """
    return docs.select("doc_id", "lang", "source", F.inline(F.array(_counts())))


def _counts() -> Column:
    # transform over a one-element array binds a name, so each array is made once for a row; as a generator's input the whole is
    # computed once, where a plain column would be computed again in every expression that uses it
    bind = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    body = bind("r", "transform(filter(s, (x, k) -> (k > 0 and get(s, k - 1).h = x.h) or get(s, k + 1).h <=> x.h), x -> x.i)", _COUNTS)
    body = bind("s", "sort_array(if(size(w) < 3, array(), transform(sequence(0, greatest(size(w) - 3, 0)), i -> named_struct('h', xxhash64(w[i], w[i + 1], w[i + 2]), 'i', i))))", body)
    body = bind("l", "filter(split(t, '\\n'), x -> x rlike '[^ \\\\t-\\\\r]')", body)
    body = bind("w", "filter(split(t, '[ \\\\t-\\\\r]+'), x -> x <> '')", body)
    return F.expr(bind("t", "coalesce(text, '')", body))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def _statistics(df: DataFrame) -> DataFrame:
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    lines = F.greatest("n_lines", F.lit(1)) if "n_lines" in df.columns else n  # counts of another source may lack it
    x = (F.log(chars / n), F.log(F.greatest("n_distinct", F.lit(1))) / F.log(1 + n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_repeat_words") / n), F.sqrt(F.col("n_dup_lines") / lines))
    return df.withColumns(dict(zip(STATS, x, strict=True)) | {"group": F.concat_ws("\u0001", F.coalesce("lang", F.lit("\u0002")), F.coalesce("source", F.lit("\u0002")))})


def _distance() -> Column:
    """Squared Mahalanobis distance from the centre m and the Cholesky factor l (its rows one after the other) that a row carries."""
    z: list[Column] = []
    for i, x in enumerate(STATS):
        z.append((F.col(x) - F.col("m")[i] - sum((F.col("l")[PAIRS.index((i, j))] * z[j] for j in range(i)), F.lit(0.0))) / F.col("l")[PAIRS.index((i, i))])
    return reduce(lambda a, b: a + b, (v * v for v in z))


def _factor(groups: DataFrame) -> DataFrame:
    """group, start, m, l, size, was: the Cholesky factor of the covariances c of each group and start, with the floors on the diagonal, and the log determinant.

    The entries are made one after the other in one fold, each from those before it, so that a plan of any number of them stays small.
    """
    floors = (*FLOORS, LINE_FLOOR)
    at = lambda *values: "array(" + ", ".join(map(str, values)) + ")"
    rows, columns = at(*(i for i, _ in PAIRS)), at(*(j for _, j in PAIRS))
    extra, least = at(*(f"{floors[i] ** 2 if i == j else 0.0}D" for i, j in PAIRS)), at(*(f"{floors[i] ** 2 / 4}D" for i, _ in PAIRS))
    start = lambda i: f"{i} * ({i} + 1) div 2"
    inner = "aggregate(zip_with(slice(l, cast({0} as int) + 1, k.j), slice(l, cast({1} as int) + 1, k.j), (x, y) -> x * y), 0.0D, (s, x) -> s + x)".format(start("k.i"), start("k.j"))
    rest = f"k.c + k.extra - {inner}"
    entry = f"if(k.i = k.j, sqrt(greatest({rest}, k.least)), ({rest}) / l[cast({start('k.j')} as int) + k.j])"
    steps = f"transform(sequence(0, {len(PAIRS) - 1}), n -> named_struct('i', {rows}[n], 'j', {columns}[n], 'c', c[n], 'extra', {extra}[n], 'least', {least}[n]))"
    factored = groups.withColumn("l", F.expr(f"aggregate({steps}, cast(array() as array<double>), (l, k) -> array_append(l, {entry}))"))
    size = 2 * reduce(lambda x, y: x + y, (F.log(F.col("l")[PAIRS.index((i, i))]) for i in range(len(STATS))))
    return factored.select("group", "start", "m", "l", size.alias("size"), "was")


def _starts(rows: DataFrame, about: DataFrame) -> DataFrame:
    """group, start, centre m and covariances c of each start; ``about`` (group, m, s) has medians and scales."""
    dims = range(len(STATS))
    floors = (*FLOORS, LINE_FLOOR)
    width = [F.sqrt(F.col("s")[i] ** 2 + floors[i] ** 2) for i in dims]
    z = rows.join(about, "group").select("group", "m", F.array(*width).alias("w"), *STATS)
    z = z.select("group", "m", "w", *[((F.col(STATS[i]) - F.col("m")[i]) / F.col("w")[i]).alias(f"z{i}") for i in dims])
    z = z.withColumn("r", F.sqrt(reduce(lambda a, b: a + b, (F.col(f"z{i}") ** 2 for i in dims))) + 1e-9)
    bent = [[F.tanh(f"z{i}") for i in dims], [F.col(f"z{i}") / F.col("r") * len(STATS) ** 0.5 for i in dims]]
    made = z.groupBy("group").agg(F.max("m").alias("m"), F.max("w").alias("w"), *[F.covar_pop(x[i], x[j]).alias(f"b{k}{i}{j}") for k, x in enumerate(bent) for i, j in PAIRS])
    found = [about.select("group", F.lit(0).alias("start"), "m", F.array(*[F.col("s")[i] ** 2 if i == j else F.lit(0.0) for i, j in PAIRS]).alias("c"))]
    found += [made.select("group", F.lit(k + 1).alias("start"), "m", F.array(*[F.col(f"b{k}{i}{j}") * F.col("w")[i] * F.col("w")[j] for i, j in PAIRS]).alias("c")) for k in range(len(bent))]
    return reduce(DataFrame.unionByName, found)


def _few(df: DataFrame, groups: int) -> DataFrame:
    """``df``, of at most so many rows, to be broadcast if they are few."""
    return F.broadcast(df) if groups <= BROADCAST_GROUPS else df


def estimates(counts: DataFrame) -> DataFrame:
    """group, centre m and Cholesky factor l for each group of ``counts``; the pooled group is the empty string."""
    passing = _statistics(counts).where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).select("group", *STATS)
    # each row stands once under its own group and once under the pool
    rows = stored(passing, "statistics").withColumn("group", F.explode(F.array("group", F.lit(""))))
    long = rows.select("group", F.posexplode(F.array(*STATS)).alias("k", "x")).groupBy("group", "k", F.round(F.col("x") * GRID).alias("bin")).agg(F.count("*").alias("n"))
    dims, every = range(len(STATS)), W.partitionBy("group", "k")
    run = long.withColumn("share", F.sum("n").over(every.orderBy("bin")) / F.sum("n").over(every))
    quarters = run.groupBy("group", "k").agg(*[F.min(F.when(F.col("share") >= q, F.col("bin"))).alias(f"q{i}") for i, q in ((1, 0.25), (2, 0.5), (3, 0.75))])
    by_statistic = lambda value: F.array(*[F.max(F.when(F.col("k") == i, value)) for i in dims])
    about = stored(quarters.groupBy("group").agg(by_statistic(F.col("q2") / GRID).alias("m"), by_statistic((F.col("q3") - F.col("q1")) / GRID / 1.349).alias("s")), "medians")
    groups = about.count()
    now = stored(_factor(_starts(rows, _few(about, groups)).withColumn("was", F.lit(None).cast("double"))), "start")
    # the expressions are the same in every step
    within = W.partitionBy("group", "start")
    bin_, off = F.floor(F.log(_distance() + 1e-9) * DISTANCE_GRID).alias("bin"), [(F.col(STATS[i]) - F.col("m")[i]).alias(f"d{i}") for i in dims]
    sums = [F.sum(f"d{i}").alias(f"s{i}") for i in dims] + [F.sum(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"p{i}{j}") for i, j in PAIRS]
    before, whole = (F.sum("n").over(within.orderBy("bin")) - F.col("n")).alias("before"), F.sum("n").over(within).alias("all")
    summed = [F.sum("n").alias("n"), F.max("was").alias("was"), F.max("m").alias("m"), *[F.sum(c).alias(c) for c in (*(f"s{i}" for i in dims), *(f"p{i}{j}" for i, j in PAIRS))]]
    mean = [F.col(f"s{i}") / F.col("n") for i in dims]
    centre, spread = F.array(*[F.col("m")[i] + mean[i] for i in dims]).alias("m"), F.array(*[(F.col(f"p{i}{j}") / F.col("n") - mean[i] * mean[j]) * CONSISTENCY for i, j in PAIRS]).alias("c")
    for step in range(STEPS):
        far = rows.join(_few(now.drop("was"), groups), "group").select("group", "start", "m", "size", bin_, *off)
        # what the fit needs is summed by bin, so one pass over the texts gives both the edge and the fit inside it
        bins = far.groupBy("group", "start", "bin").agg(F.count("*").alias("n"), F.max("size").alias("was"), F.max("m").alias("m"), *sums)
        fit = bins.select("*", before, whole).where(F.col("before") < SUPPORT * F.col("all")).groupBy("group", "start").agg(*summed)
        fit = fit.where((F.col("n") >= SUPPORT * MIN_GROUP) | (F.col("group") == ""))
        now = stored(_factor(fit.select("group", "start", "was", centre, spread)), "step")
        if step % LOOK == LOOK - 1:
            moved = now.agg(F.max(F.abs(F.col("size") - F.col("was")))).first()[0]
            if moved is None or moved < 1e-9:
                break
    best = now.withColumn("least", F.min("size").over(W.partitionBy("group"))).where(F.col("size") <= F.col("least") + TIE)
    return stored(best.groupBy("group").agg(F.min_by(F.struct("m", "l"), "start").alias("e")).select("group", "e.*"), "estimates")


def judged(counts: DataFrame, fitted: DataFrame) -> DataFrame:
    """``counts`` (one row for each text) with base_failed, distance (null where the base rule fails) and kept.

    The estimates have a row for each group and are broadcast while the groups are few. A group without an
    estimate of its own takes the pooled one; without that (no text passes the base rule) nothing is an outlier.
    """
    df = _statistics(counts).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    names = [c for c in fitted.columns if c != "group"]
    own = fitted.where("group <> ''").select("group", F.struct(*names).alias("_own"))
    pool = fitted.where("group = ''").select(F.lit(1).alias("_one"), F.struct(*names).alias("_all"))
    df = df.join(_few(own, fitted.count()), "group", "left").withColumn("_one", F.lit(1)).join(F.broadcast(pool), "_one", "left")  # the pool is one row
    df = df.withColumn("_e", F.coalesce("_own", "_all")).select("*", "_e.*")
    df = df.withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return df.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUT)).drop("group", *STATS, *names, "_own", "_all", "_one", "_e")


def kept_documents(docs: DataFrame, fitted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns; texts are counted in place, so that they are not shuffled."""
    columns = docs.columns
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"), "doc_id", "lang", "source", "text")
    counts = nested.select("_doc", "doc_id", "lang", "source", F.inline(F.array(_counts())))
    return judged(counts, fitted).where("kept").select("_doc.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stored(counted(table(spark, sf_dir, "documents")), "counts")
    return judged(counts, estimates(counts)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
