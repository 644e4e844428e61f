"""Document fingerprints by one-permutation MinHash, in built-in functions alone.

Every shingle is hashed once: the top bits name its bin, and a bin keeps its least hash. An empty bin asks bins
in a random order of its own until one is filled, which spreads the loans evenly and alike for all texts
(optimal densification). Of each bin the low-order bits are kept, packed into longs; the share of agreeing
bins, corrected for chance agreement of so few bits, estimates the Jaccard likeness of the shingle sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import fresh, words_of
from parley.session import materialise

BINS, BITS, PROBES = 256, 4, 64
PER_LONG = 64 // BITS
REST = (1 << 56) - 1  # of a hash, what is compared within its bin


def shingle_hashes(words: str, size: int) -> Column:
    """Hashes of all shingles of `size` words of the array column; of fewer words, but not none, the whole is one."""
    n = f"size(`{words}`)"
    hashes = f"transform(`{words}`, x -> xxhash64(x))"
    each = ", ".join(["h", *[f"get(hs, i + {k})" for k in range(1, size)]])
    # the hashes of the words are held in a one-element array, so that they are computed once
    long = f"flatten(transform(array({hashes}), hs -> slice(transform(hs, (h, i) -> xxhash64({each})), 1, {n} - {size - 1})))"
    return F.expr(f"CASE WHEN {n} >= {size} THEN {long} WHEN {n} > 0 THEN array(xxhash64(`{words}`)) ELSE cast(array() as array<bigint>) END")


def bin_minima(hashes: str) -> Column:
    """The least hash of every bin, in the order of the bins; an empty bin holds REST in its lower bits."""
    fillers = f"transform(sequence(0, {BINS - 1}), j -> shiftleft(cast(j as bigint), 56) | {REST}L)"
    least = "filter(s, (x, i) -> i = 0 OR shiftrightunsigned(x, 56) != shiftrightunsigned(get(s, i - 1), 56))"
    return F.expr(f"flatten(transform(array(sort_array(concat(`{hashes}`, {fillers}))), s -> {least}))")


def densified(minima: str) -> Column:
    """The low-order bits of every bin, empty bins filled from the others; null where all are empty.

    A bin that is empty asks the bins that the hashes of (probe, its number) name, PROBES of them at most, until one is
    filled; where all are empty, which only very short texts see, it takes the filled one of least hash with its number.
    """
    low = (1 << BITS) - 1
    own = f"transform(`{minima}`, x -> if((x & {REST}L) != {REST}L, cast(x & {low} as int), null))"
    probes = ", ".join(f"get(own, cast(xxhash64(a + {k}, j) & {BINS - 1} as int))" for k in range(8))  # a round of eight
    asked = f"aggregate(sequence(0, {PROBES - 8}, 8), own, (held, a) -> transform(held, (v, j) -> coalesce(v, {probes})))"
    others = f"filter(sequence(0, {BINS - 1}), i -> get(own, i) IS NOT NULL)"
    least = f"cast(array_min(transform({others}, i -> (xxhash64(j, i) & ~{low}L) | get(own, i))) & {low} as int)"
    return F.expr(f"flatten(transform(array({own}), own -> transform({asked}, (v, j) -> coalesce(v, {least}))))")


def packed(codes: str) -> Column:
    """Low-order bits of all bins as longs of PER_LONG bins each; all zero where there is none."""
    one = f"aggregate(slice(held, g * {PER_LONG} + 1, {PER_LONG}), 0L, (t, c) -> shiftleft(t, {BITS}) | coalesce(c, 0L))"
    return F.expr(f"flatten(transform(array(`{codes}`), held -> transform(sequence(0, {BINS // PER_LONG - 1}), g -> {one})))")


def with_fingerprint(df: DataFrame, text: Column, name: str, shingle: int = 5) -> DataFrame:
    """df with the packed fingerprint of a text as an array of longs; null and blank texts have all zeros."""
    words, hashes, minima, codes = (fresh(df, x) for x in ("_words", "_hashes", "_minima", "_codes"))
    d = df.withColumn(words, words_of(text)).withColumn(hashes, shingle_hashes(words, shingle)).drop(words)
    d = d.withColumn(minima, bin_minima(hashes)).drop(hashes).withColumn(codes, densified(minima)).drop(minima)
    return d.withColumn(name, packed(codes)).drop(codes)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness, 0 to 1, of two packed fingerprints: agreeing bins, less the share that agrees by chance.

    Two texts without words are alike (1); one without words is like no other (0).
    """
    nibbles = 0x1111111111111111
    apart = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    folded = lambda x: F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3)).bitwiseAND(F.lit(nibbles)))
    differing = F.aggregate(apart, F.lit(0), lambda t, x: t + folded(x))
    chance = 1.0 / (1 << BITS)
    share = (F.lit(1.0) - differing / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1 - chance)
    none = lambda x: ~F.exists(x, lambda v: v != 0)
    return F.when(none(a) & none(b), F.lit(1.0)).when(none(a) | none(b), F.lit(0.0)).otherwise(F.greatest(share, F.lit(0.0)))


def as_hex(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(df: DataFrame, id_col: str, text_col: str, carried: list[str], block_rows: int = 100, most_blocks: int = 1 << 18) -> DataFrame:
    """df with next_<c>, for each carried column, of the next row in descending order of the ids (after the last: the first).

    The ids alone are sorted by ranges; every block_rows-th one begins a block, at most about most_blocks. Rows go to
    their block in one shuffle, the first of each block also to the block before, and each block looks ahead in itself.
    Rows of one id follow the hash of their text; a null id comes last.
    """
    key, block, shown, mark = (fresh(df, x) for x in ("_key", "_block", "_shown", "_mark"))
    rows = df.withColumn(key, F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("tie")))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select(key).repartitionByRange(parts, F.desc(key)).sortWithinPartitions(F.desc(key)).withColumn(mark, F.monotonically_increasing_id())
    keys = materialise(keys, "fingerprint-order")
    block_rows = max(block_rows, -(-keys.count() // most_blocks))
    # the first key of each range begins a block, and so does every block_rows-th after it
    heads = keys.filter(F.col(mark).bitwiseAND(F.lit((1 << 33) - 1)) % block_rows == 0).select(key).distinct()
    bounds = heads.agg(F.sort_array(F.collect_list(key)).alias("b")).scalar()
    found = rows.withColumn(mark, bounds)
    steps = f"sequence(1, {(most_blocks + parts + 1).bit_length() + 1})"
    middle = "cast((t.lo + t.hi) / 2 as int)"
    go = f"if(t.lo >= t.hi, t, if(get(`{mark}`, {middle}) < `{key}`, named_struct('lo', {middle} + 1, 'hi', t.hi), named_struct('lo', t.lo, 'hi', {middle})))"
    # the least bound that is no less than the key; blocks count upwards, rows run downwards
    place = F.expr(f"aggregate({steps}, named_struct('lo', 0, 'hi', size(`{mark}`) - 1), (t, i) -> {go}, t -> t.lo)")
    found = found.withColumn(block, place)
    is_head = F.get(F.col(mark), F.col(block)) == F.col(key)
    before = F.when(F.col(block) == F.size(mark) - 1, F.lit(0)).otherwise(F.col(block) + 1)
    own, guest = F.struct(F.col(block).alias("at"), F.lit(True).alias("own")), F.struct(before.alias("at"), F.lit(False).alias("own"))
    spread = found.select(*df.columns, key, F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))).alias(shown))
    spread = spread.select(*df.columns, key, F.col(shown)["at"].alias(block), F.col(shown)["own"].alias(shown))
    ahead = Window.partitionBy(block).orderBy(F.desc(shown), F.desc(key))
    return spread.withColumns({f"next_{c}": F.lead(c).over(ahead) for c in carried}).filter(F.col(shown)).drop(key, block, shown)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    r"""The fingerprint of every row of docs: id, n_chars (code points), fingerprint (packed longs).

    Words are `[^\x20\x09-\x0D]+`, unchanged. Null text: an empty one. Null id: passed on. Repeated rows have equal results. Empty table:
    empty result. Other columns are not read.
    """
    d = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return with_fingerprint(d, F.col("text"), "fingerprint", shingle).select(id_col, F.length("text").cast("bigint").alias("n_chars"), "fingerprint")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, edited_part: int = 3) -> DataFrame:
    """Fingerprints of texts, of the same texts with their last part replaced, and how alike they are by the fingerprints.

    The last floor(n_chars / edited_part) code points give way to as many first ones, or all, of the next document in
    descending order of ids, after the last the first. Returns id, n_chars, edited (the text), fingerprint, edited_fingerprint
    (packed longs), near_edited and near_next (likeness to the edited text and to the next document).

    Null text: an empty one. Null id: last in the order. Rows of one id follow the hash of their text; repeated rows are
    each other's next. One row is its own next. Empty table: empty result. Other columns are not read.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    d = with_next(with_fingerprint(d, F.col("text"), "fp", shingle), "id", "text", ["text", "fp"])
    n = F.length("text")
    cut = F.floor(n / edited_part).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    d = with_fingerprint(d.select("id", n.cast("bigint").alias("n_chars"), "fp", "next_fp", edited.alias("edited")), F.col("edited"), "efp", shingle)
    return d.select(
        F.col("id").alias(id_col), "n_chars", "edited", F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
