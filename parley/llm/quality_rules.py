r"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

A sketch is the row counts of a metric's logarithmic buckets (relative error 1 %): two sketches merge by
adding counts, so the same partial aggregation that Spark runs map-side builds them, a language's sketch is
the sum of its sources', and a source with a third of all rows costs no task more than another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import broadcast_if_small, words_of
from parley.session import materialise

GAMMA = 1.02
UNIT = 0.001
#: metric: (least distance of its upper fence from the upper quartile, the same below the lower one or None): the metric's
#: resolution, of which README says how many groups it decides.
METRICS = {"symbol_ratio": (0.02, None), "dup_line_ratio": (0.05, None), "repeat_ratio": (0.05, None), "mean_word": (0.25, 0.25)}
#: Quartile distances beyond the quartiles; where these coincide, the first of LADDER's quantiles off the median sets the scale.
FENCE = 4.0
LADDER = (0.9, 0.95, 0.98, 0.99)
QUANTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75} | {f"q{round(100 * p)}": p for p in LADDER}
#: A group's quartiles weigh as its rows, those of the level above as so many.
PRIOR = 50.0


def bucket_of(value: Column) -> Column:
    """The sketch's bucket of a value of 0 or more."""
    return F.floor(F.log(1 + value / UNIT) / F.log(F.lit(GAMMA))).cast("int")


def value_of(bucket: Column) -> Column:
    """The middle of a bucket."""
    return UNIT * (F.pow(F.lit(GAMMA), bucket + 0.5) - 1)


def measure(docs: DataFrame, window: int = 8) -> DataFrame:
    r"""Base metrics of every row: doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Words are `[^\x20\x09-\x0D]+` of the whole text. A null or blank text measures zero everywhere.
    Repeated windows are found inside the row: hashes of all windows, a distinct count that settles the
    usual case of no repeat, and one sort of (hash, position) pairs for the rest.
    """
    text = F.col("text")
    blank = F.array().cast("array<bigint>")
    d = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("w", words_of(text))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("lines", lines)
    d = d.select(
        "doc_id", "lang", "source",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("wh"),
    )
    windows = F.transform(F.sequence(F.lit(1), (F.col("n_words") - window + 1).cast("int")), lambda i: F.xxhash64(F.slice("wh", i, window)))
    d = d.withColumn("h", F.when(F.col("n_words") >= window, windows).otherwise(blank))
    pairs = F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(pairs)))
    # positions of windows that have an equal neighbour in hash order, then the words that they cover
    again = F.expr("sort_array(transform(filter(s, (e, k) -> (k > 0 and s[k - 1].h = e.h) or (k < size(s) - 1 and s[k + 1].h = e.h)), e -> e.i))")
    d = d.withColumn("at", again)
    covered = F.expr(f"aggregate(at, named_struct('n', 0L, 'e', 0), (t, i) -> named_struct('n', t.n + i + {window} - greatest(i, t.e), 'e', i + {window}), t -> t.n)")
    return d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def with_ratios(measured: DataFrame) -> DataFrame:
    """The metrics that thresholds adapt to; 0 where a denominator is 0."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return measured.withColumns({
        "symbol_ratio": ratio("n_symbols", "word_chars"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"), "mean_word": ratio("word_chars", "n_words"),
    })


def sketches(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Bucket counts of each metric by the given keys: keys, metric, bucket, n. Rows without words are left out."""
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket_of(F.col(m)).alias("bucket")) for m in METRICS])).alias("x")
    return metrics.filter("n_words > 0").select(*keys, stacked).select(*keys, "x.*").groupBy(*keys, "metric", "bucket").agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches merged up to fewer keys."""
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, rows and QUANTILES of each sketch."""
    by = Window.partitionBy(*keys, "metric")
    ranked = sketch.withColumn("total", F.sum("n").over(by)).withColumn("upto", F.sum("n").over(by.orderBy("bucket")))
    quantile = lambda p: value_of(F.min(F.when(F.col("upto") >= p * F.col("total"), F.col("bucket"))))
    return ranked.groupBy(*keys, "metric").agg(F.first("total").alias("rows"), *[quantile(p).alias(q) for q, p in QUANTILES.items()])


def blended(cell: DataFrame) -> DataFrame:
    """lang, source, metric and QUANTILES: each group's own, drawn towards its language's, and those towards all's.

    A group of n rows weighs n against PRIOR of the level above, so no number of rows switches from one to the other.
    """
    own, lang = quantiles(cell, ["lang", "source"]), quantiles(merge(cell, ["lang"]), ["lang"])
    every = quantiles(merge(cell, []), []).select("metric", *[F.col(q).alias(f"all_{q}") for q in QUANTILES])
    share = lambda n: n / (n + PRIOR)
    mix = lambda w, a, b: w * F.col(a) + (1 - w) * F.col(b)
    upper = lang.join(every, "metric").select(F.col("lang").alias("of"), "metric", *[mix(share(F.col("rows")), q, f"all_{q}").alias(f"up_{q}") for q in QUANTILES])
    both = own.join(upper, own.lang.eqNullSafe(upper.of) & (own.metric == upper.metric))
    return both.select("lang", "source", own.metric, *[mix(share(F.col("rows")), q, f"up_{q}").alias(q) for q in QUANTILES])


def limits(found: DataFrame) -> DataFrame:
    """found (metric and QUANTILES) with hi and lo, and hi_least and lo_least: whether the metric's resolution decides them.

    Where the quartiles differ, a fence lies FENCE quartile distances beyond them. Where most values are one, as of
    symbols or repeated lines, the upper fence lies as far beyond the first quantile of LADDER that leaves the median as
    that lies beyond the median, or at the last of LADDER if none does.
    """
    pick = lambda k: F.get(F.array(*[F.lit(v[k]).cast("double") for v in METRICS.values()]), F.array_position(F.array(*map(F.lit, METRICS)), F.col("metric")).cast("int") - 1)
    apart = F.col("q75") - F.col("q25")
    steps = [F.when(F.col(q) > F.col("q50"), 2 * F.col(q) - F.col("q50")) for q in QUANTILES if QUANTILES[q] in LADDER]
    high = F.when(apart > 0, F.col("q75") + FENCE * apart).otherwise(F.coalesce(*steps, F.col(list(QUANTILES)[-1])))
    low, least_hi, least_lo = F.col("q25") - FENCE * apart, F.col("q75") + pick(0), F.col("q25") - pick(1)
    return found.withColumns({
        "hi": F.greatest(high, least_hi), "lo": F.when(pick(1).isNotNull(), F.least(low, least_lo)).otherwise(F.lit(-1.0)),
        "hi_least": high < least_hi, "lo_least": pick(1).isNotNull() & (low > least_lo),
    })


def fences(found: DataFrame, keys: list[str]) -> DataFrame:
    """Quantiles turned into fences: keys, lo_ and hi_ of each metric."""
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{c}_{m}")
    return limits(found).groupBy(*keys).agg(*[pick(m, c) for m in METRICS for c in ("hi", "lo")])


def judge_quality(docs: DataFrame, max_broadcast: int = 50_000) -> DataFrame:
    """Judge every row of docs (doc_id, text, lang, source) by its own group's thresholds.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.
    base_failed: under 20 words, or over 30 % of the words in repeated 8-word windows. kept: base passed and
    each metric within its group's fences (limits). Every row is judged by its own (lang, source) group's quantiles,
    blended with those above.

    Null lang or source is a group of its own. Null or blank text: no words, base_failed. Repeated rows are
    judged alike, one result each. Empty table: empty result. Other columns are not read.
    """
    metrics = materialise(with_ratios(measure(docs)), "quality-metrics")
    cell = materialise(sketches(metrics, ["lang", "source"]), "quality-sketches")
    table = fences(blended(cell), ["lang", "source"]).withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    table = materialise(table, "quality-fences")
    joined = metrics.join(broadcast_if_small(table, max_broadcast), metrics.lang.eqNullSafe(F.col("g_lang")) & metrics.source.eqNullSafe(F.col("g_source")), "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    within = reduce(lambda a, b: a & b, [F.col(m).between(F.col(f"lo_{m}"), F.col(f"hi_{m}")) for m in METRICS])
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.coalesce(within, F.lit(True))).alias("kept"),
    )
