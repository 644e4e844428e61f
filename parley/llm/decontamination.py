r"""Benchmark decontamination as a prefix-filtered set join.

An item window is the set of its word shingles; a document holds the window only if it holds every shingle,
so one necessary prefix token, the shingle that is rarest over all documents, is joined. Length and
positional bounds then fix where the window would have to lie, and its words are compared one by one.

Documents are tokenised once. Their shingles meet a Bloom filter of the benchmark's tokens, one row of bits whose
size is bounded whatever the benchmark's, and only those that pass are written, to be counted and joined. What
the filter lets through by chance costs a row, never a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import broadcast_if_small, lower_ascii
from parley.session import materialise

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    r"""A-Z lower-cased, then words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`; null has none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), lambda w: w != "")


def shingle(words: str, start: Column, size: int | Column) -> Column:
    """The token of the `size` words from the 1-based start of an array of word hashes."""
    return F.xxhash64(F.slice(words, start, size))


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Windows of all items: item_id, wkey (the words, space-joined), words, wh (their hashes). Items without words have none."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), item_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    w = w.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), size).alias("words")).distinct()
    return w.select("item_id", F.array_join("words", " ").alias("wkey"), "words", F.transform("words", lambda x: F.xxhash64(x)).alias("wh"))


def text_digest(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def bloom(tokens: DataFrame, most_bits: int = 1 << 26) -> tuple[DataFrame, int]:
    """(one row of `bits`, the 64-bit words of a Bloom filter of the column `token` with two hashes, and their number).

    About 256 bits a token up to `most_bits`, 8 MB; past that the filter passes more and stays as large.
    """
    n = 1 << 10
    count = tokens.count()
    while n * 64 < min(256 * count, most_bits):
        n *= 2
    places = F.explode(F.array(*[F.struct(word.alias("i"), bit.alias("bit")) for word, bit in _places(F.col("token"), n)])).alias("p")
    words = tokens.select(places).groupBy(F.col("p.i").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, p.bit)")).alias("bits"))
    every = tokens.sparkSession.range(n).withColumnRenamed("id", "i").join(words, "i", "left").select("i", F.coalesce("bits", F.lit(0)).cast("bigint").alias("bits"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "bits"))), lambda x: x["bits"]).alias("bits")), n


def _places(token: Column, n: int) -> list[tuple[Column, Column]]:
    """(word, bit) of both hashes of a token in a filter of n words: its low and its high half."""
    half = [token, F.shiftrightunsigned(token, 32)]
    return [(F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(n - 1)).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int")) for h in half]


def _hits(docs: DataFrame, sizes: list[int], tokens: DataFrame) -> DataFrame:
    """One tokenisation of docs: rows of doc_id, digest, n_words with token null for every document, and one for each shingle that passes.

    Columns size, token and at (the shingle's first word, from 0) say which one passed.
    """
    d = docs.select("doc_id", text_digest(F.col("text")).alias("digest"), item_words(F.col("text")).alias("w"))
    d = d.select("doc_id", "digest", F.size("w").cast("bigint").alias("n_words"), F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))
    # of k words from each place; places too near the end hash fewer words and are cut off. The same as shingle()
    words_of = lambda k: ", ".join(["h", *[f"get(wh, i + {j})" for j in range(1, k)]])
    every = [F.expr(f"slice(transform(wh, (h, i) -> xxhash64({words_of(k)})), 1, greatest(size(wh) - {k - 1}, 0))") for k in sizes]
    d = d.select("doc_id", "digest", "n_words", F.posexplode(F.concat(F.array(F.lit(None).cast("bigint")), *every)).alias("at", "token"))
    bits, n = bloom(tokens)
    filter_ = bits.scalar()
    passed = [F.get(filter_, word).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)) != 0 for word, bit in _places(F.col("token"), n)]
    d = d.filter(F.col("token").isNull() | (passed[0] & passed[1]))
    # where the shingles of each size begin in the list
    size, at, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1)
    for k in sizes:
        own = F.greatest(F.col("n_words") - k + 1, F.lit(0))
        here = F.col("token").isNotNull() & (F.col("at") >= before) & (F.col("at") < before + own)
        size, at, before = F.when(here, F.lit(k)).otherwise(size), F.when(here, F.col("at") - before).otherwise(at), before + own
    return d.select("doc_id", "digest", "n_words", size.alias("size"), "token", at.cast("int").alias("at"))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, size: int = 13, token_words: int = 4, max_broadcast: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Where windows of benchmark items occur in docs.

    Returns (every row as doc_id, digest, n_words; one row per occurrence as doc_id, digest, start, length, item_id).
    start counts words from 0. Both rest on written tables; rows of one doc_id and text count once in the second.
    """
    windows = materialise(item_windows(benchmark, size), "decon-windows")
    # tokens of every window: shingles of token_words words, or the whole of a shorter window
    k = F.least(F.size("wh"), F.lit(token_words))
    offsets = F.explode(F.sequence(F.lit(0), F.size("wh") - k)).alias("o")
    tokens = windows.select("wkey", "wh", offsets, k.alias("size")).select("wkey", F.size("wh").alias("length"), "size", "o", shingle("wh", F.col("o") + 1, F.col("size")).alias("token")).dropDuplicates(["wkey", "o"])
    tokens = materialise(tokens, "decon-tokens")
    distinct = tokens.select("size", "token").distinct()
    sizes = sorted(r["size"] for r in distinct.select("size").distinct().collect())  # token_words values at most
    hits = materialise(_hits(docs, sizes, distinct), "decon-hits")
    rows, found = hits.filter("token IS NULL").select("doc_id", "digest", "n_words"), hits.filter("token IS NOT NULL")

    # order each window's tokens by rarity over all documents; a token that no document holds rules its windows out
    frequency = found.groupBy("size", "token").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("wkey").orderBy("df", "o")
    prefix = tokens.join(frequency, ["size", "token"], "left").fillna(0, ["df"]).withColumn("r", F.row_number().over(rarest)).filter("r = 1 AND df > 0")
    prefix = materialise(prefix.select("wkey", "length", "size", "o", "token"), "decon-prefix")
    start = F.col("at") - F.col("o")
    inside = (start >= 0) & (start + F.col("length") <= F.col("n_words"))  # positional and length bounds
    cand = found.join(broadcast_if_small(prefix, max_broadcast), ["size", "token"]).filter(inside).select("doc_id", "digest", start.alias("start"), "wkey").distinct()
    cand = materialise(cand, "decon-candidates")

    # the words of those documents that hold a candidate, once each, against the window's own
    held = broadcast_if_small(cand.select(F.col("doc_id").alias("d"), F.col("digest").alias("g")).distinct(), max_broadcast)
    texts = docs.select("doc_id", text_digest(F.col("text")).alias("digest"), "text")
    texts = texts.join(held, texts.doc_id.eqNullSafe(F.col("d")) & texts.digest.eqNullSafe(F.col("g")), "left_semi").dropDuplicates(["doc_id", "digest"])
    near = cand.join(broadcast_if_small(windows.select("wkey", "words").dropDuplicates(["wkey"]), max_broadcast), "wkey").select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "start", "wkey", "words")
    words = texts.select("doc_id", "digest", item_words(F.col("text")).alias("w"))
    pairs = words.join(near, words.doc_id.eqNullSafe(near.d) & words.digest.eqNullSafe(near.g))
    hit = pairs.filter(F.slice("w", F.col("start") + 1, F.size("words")) == F.col("words")).select("doc_id", "digest", "start", F.size("words").alias("length"), "wkey")
    items = windows.select("item_id", "wkey").distinct()
    return rows, materialise(hit.join(broadcast_if_small(items, max_broadcast), "wkey").select("doc_id", "digest", "start", "length", "item_id").distinct(), "decon-spans")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, percent: int = 5) -> DataFrame:
    """What decontaminate returns, with the digest (text_digest) that tells apart rows of one doc_id."""
    rows, spans = contaminated_spans(docs, benchmark, size)
    union = "aggregate(array_sort(at), named_struct('n', 0L, 'e', 0), (t, x) -> named_struct('n', t.n + greatest(x.start + x.length - greatest(x.start, t.e), 0), 'e', greatest(t.e, x.start + x.length)), t -> t.n)"
    per = spans.groupBy(F.col("doc_id").alias("d"), F.col("digest").alias("g")).agg(F.collect_set(F.struct("start", "length")).alias("at"), F.collect_set("item_id").alias("items"))
    per = per.select("d", "g", F.expr(union).alias("n_hit"), F.array_sort("items").alias("items"))
    joined = rows.join(per, rows.doc_id.eqNullSafe(per.d) & rows.digest.eqNullSafe(per.g), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "digest", F.col("n_words").cast("bigint").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, percent: int = 5) -> DataFrame:
    """Contamination of every row of docs (doc_id, text) by benchmark (item_id, text).

    Returns doc_id, n_words, n_hit (words inside occurrences), n_items, items_sha256, contaminated
    (n_hit > 0 and n_hit at least `percent` % of n_words).

    Null text: no words, never contaminated. Items without words are skipped; a null item_id counts as the
    empty id. Repeated documents get equal results, one row each; repeated items count once. Empty tables on
    either side give no hits. Other columns are not read.
    """
    return contamination(docs, benchmark, size, percent).drop("digest")
