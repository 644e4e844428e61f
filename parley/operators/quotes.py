"""Quotes against what was said: a similarity join in which only pairs that can match meet, and none is lost.

In a meeting of at most SMALL lines a quote meets every line, which costs SMALL pairs a quote at most and shuffles each text
once. In longer meetings equal texts are one class, so copies make no pairs. Classes then meet by three rules, each with a
necessary condition that an equality on a rare term can test:

* containment: all trigrams of the contained text occur in the other, so its rarest one does;
* shared tokens: a line with a share of a quote's tokens has one of the quote's rarest, as many as may be missing and one;
* sequence ratio: the matched stretches of two alike texts share so many pairs of neighbouring letters that, with letter
  pairs in one order of rarity, the rarest of both, as many as may be missing and one, have one in common. In long texts of
  few rare letters the stretches are few, so long runs of letters take the place of pairs.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.session import materialise

SLACK = 1e-9  # keeps rounding from raising a bound
#: Lines of a meeting up to which its quotes meet all of them.
SMALL = 64
#: Letters from which on difflib looks up no letter that makes up over 1 % of the second text.
LOOKED_UP = 200
#: Lengths of the runs of letters by which lines of few rare letters are found.
RUNS = (6, 8, 12)


def _check(fuzzy: float = 1, overlap: float = 1) -> None:
    if not 5 / 6 < fuzzy <= 1:
        raise ValueError("fuzzy must be above 5/6 and at most 1, so that alike texts share letter pairs")
    if overlap <= 0:
        raise ValueError("overlap must be above 0")


def _grams(norm: Column) -> tuple[Column, Column, Column]:
    """A text's letters, and its runs of two and of three letters, in order."""
    letters = F.regexp_extract_all(norm, F.lit("(?s)."), F.lit(0))
    end = F.greatest(F.length(norm), F.lit(1))
    pairs = F.zip_with(letters, F.slice(letters, F.lit(2), end), lambda a, b: F.concat(a, b))
    triples = F.zip_with(pairs, F.slice(letters, F.lit(3), end), lambda a, b: F.concat(a, b))
    return letters, F.filter(pairs, lambda g: g.isNotNull()), F.filter(triples, lambda g: g.isNotNull())


def _bag(norm: Column) -> Column:
    """A text's letters, numbered within each letter, so that two texts' common elements count as often as both have them."""
    count = lambda c: F.length(norm) - F.length(F.replace(norm, c, F.lit("")))
    numbered = lambda c: F.transform(F.sequence(F.lit(1), count(c)), lambda i: F.concat(c, i.cast("string")))
    return F.flatten(F.transform(F.array_distinct(_grams(norm)[0]), numbered))


def _read(rows: DataFrame, id_: str, text: str) -> DataFrame:
    d = rows.select("meeting_id", F.col(id_).alias("id"), X.normalise(F.col(text)).alias("norm"), F.array_sort(F.array_distinct(X.tokens(F.col(text)))).alias("words"))
    return d.filter("norm <> ''")


def _classes(rows: DataFrame) -> DataFrame:
    """One row for each text of a meeting, with its smallest id."""
    return rows.groupBy("meeting_id", "norm", "words").agg(F.min("id").alias("id"))


def _met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that never broadcasts: Spark sizes exploded rows as the rows before, and texts as they are compressed."""
    return left.join(right.hint("merge"), on, how)


def _by_size(read: DataFrame, heard: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines of small meetings, and quotes and lines of the others."""
    large = lines.groupBy("meeting_id").agg(F.count("*").alias("n")).filter(F.col("n") > SMALL).select("meeting_id")
    return heard.join(large, "meeting_id", "left_anti"), read.join(large, "meeting_id", "left_semi"), heard.join(large, "meeting_id", "left_semi")


def _meet(read: DataFrame, few: DataFrame, test: Column, how: str = "inner") -> DataFrame:
    """Quotes and the lines (position, hay, heard) of their small meetings that pass a test."""
    said = few.select(F.col("meeting_id").alias("of"), F.col("id").alias("position"), F.col("norm").alias("hay"), F.col("words").alias("heard"))
    return _met(read, said, (F.col("meeting_id") == F.col("of")) & test, how)


def _within(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs (meeting_id, a, b) of classes where a text of `long` (b) contains one of `short` (a)."""
    one, two, three = _grams(F.col("norm"))
    n = F.length("norm")
    own = F.when(n >= 3, F.array_distinct(three)).otherwise(F.array("norm"))
    posts = long.select("meeting_id", F.col("id").alias("b"), n.alias("m"), F.explode(F.array_distinct(F.concat(one, two, three))).alias("gram"))
    held = posts.groupBy("meeting_id", "gram").agg(F.count("*").alias("lines"))
    rank = F.struct(F.coalesce("lines", F.lit(0)), "gram")
    asked = short.select("meeting_id", F.col("id").alias("a"), n.alias("n"), F.explode(own).alias("gram"))
    asked = _met(asked, held, ["meeting_id", "gram"], "left")
    rarest = asked.groupBy("meeting_id", "a", "n").agg(F.min_by("gram", rank).alias("gram"))
    pairs = _met(rarest, posts, ["meeting_id", "gram"]).filter("m >= n").select("meeting_id", "a", "b")
    pairs = _met(pairs, short.select("meeting_id", F.col("id").alias("a"), F.col("norm").alias("needle")), ["meeting_id", "a"])
    pairs = _met(pairs, long.select("meeting_id", F.col("id").alias("b"), F.col("norm").alias("hay")), ["meeting_id", "b"])
    return pairs.filter(F.contains("hay", F.col("needle"))).select("meeting_id", "a", "b")


def _contained(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    there = _within(quotes, lines).select("meeting_id", F.col("a").alias("id"), F.col("b").alias("position"))
    back = _within(lines, quotes).select("meeting_id", F.col("b").alias("id"), F.col("a").alias("position"))
    return there.unionByName(back).groupBy("meeting_id", "id").agg(F.min("position").alias("position"))


def _shared(quotes: DataFrame, lines: DataFrame, overlap: float) -> DataFrame:
    n = F.size("words")
    need = F.ceil(F.lit(overlap) * n - SLACK)
    posts = lines.select("meeting_id", F.col("id").alias("position"), n.alias("m"), F.explode("words").alias("word"))
    held = posts.groupBy("meeting_id", "word").agg(F.count("*").alias("lines"))
    asked = quotes.filter(n >= 2).select("meeting_id", "id", need.alias("need"), (n - need + 1).alias("prefix"), F.explode("words").alias("word"))
    rarest = Window.partitionBy("meeting_id", "id").orderBy(F.coalesce("lines", F.lit(0)), "word")
    asked = _met(asked, held, ["meeting_id", "word"], "left").withColumn("r", F.row_number().over(rarest)).filter("r <= prefix AND lines IS NOT NULL")
    pairs = _met(asked, posts, ["meeting_id", "word"]).filter("m >= need").select("meeting_id", "id", "position").distinct()
    pairs = _met(pairs, quotes.select("meeting_id", "id", "words"), ["meeting_id", "id"])
    pairs = _met(pairs, lines.select("meeting_id", F.col("id").alias("position"), F.col("words").alias("heard")), ["meeting_id", "position"])
    return pairs.filter(F.size(F.array_intersect("words", "heard")) / n >= overlap).select("meeting_id", "id").distinct()


def alike_candidates(quotes: DataFrame, lines: DataFrame, fuzzy: float) -> DataFrame:
    """Pairs of classes (meeting_id, id, position, needle, hay) that hold every pair with a sequence ratio of `fuzzy`.

    Lines of few rare letters meet by long runs, all others by letter pairs.
    """
    _check(fuzzy=fuzzy)
    n = F.length("norm")
    lines = materialise(_runs(lines.withColumn("id", F.col("id").cast(quotes.schema["id"].dataType)), fuzzy), "quotes-runs")
    others = lines.filter("run IS NULL")
    longest = others.groupBy("meeting_id").agg(F.max(n).alias("longest"))
    reached = _met(quotes, longest, "meeting_id").filter(fuzzy * n <= (2 - fuzzy) * F.col("longest") + SLACK).drop("longest")
    return _by_runs(quotes, lines.filter("run IS NOT NULL"), fuzzy).unionByName(_by_pairs(reached, others, fuzzy))


def _runs(lines: DataFrame, fuzzy: float) -> DataFrame:
    """Lines with `run`, a number of letters, and `sure`, how many places of such runs lie in what any alike text matches; null if too few.

    A text of LOOKED_UP letters or more is matched in stretches that hold one of its R rare letters each, and one more that
    starts it (most_matched). So at most R + 1 stretches hold at least fuzzy m / (2 - fuzzy) of its m letters, as m / n
    is at least fuzzy / (2 - fuzzy) and at most its inverse; a stretch of k letters has k - q + 1 places of runs of q.
    """
    m = F.length("norm")
    times = lambda c: F.length("norm") - F.length(F.replace("norm", c, F.lit("")))
    letters = F.array_distinct(F.regexp_extract_all("norm", F.lit("(?s)."), F.lit(0)))
    rare = F.aggregate(F.transform(letters, lambda c: times(c) / F.length(c)), F.lit(0.0), lambda s, k: s + F.when(k <= F.floor(m / 100) + 1, k).otherwise(0.0))
    d = lines.withColumn("rare", rare)
    sure = lambda q: F.ceil(fuzzy / (2 - fuzzy) * m - (F.col("rare") + 1) * (q - 1) - SLACK)
    best = F.lit(None).cast("struct<run:int,sure:bigint>")
    for q in RUNS:
        best = F.when(sure(q) >= m / 4, F.struct(F.lit(q).alias("run"), sure(q).alias("sure"))).otherwise(best)
    d = d.withColumn("best", F.when(m >= LOOKED_UP, best))
    return d.select(*lines.columns, F.col("best.run").alias("run"), F.col("best.sure").alias("sure"))


def _by_runs(quotes: DataFrame, lines: DataFrame, fuzzy: float) -> DataFrame:
    """Of the places of a line's runs all but `sure` may be unmatched, so of so many distinct runs and one more an alike quote has one: those that the fewest quotes have."""
    own = lambda q: F.regexp_extract_all("norm", F.lit("(?s)(?=(.{%d}))" % q), F.lit(1))
    n = F.length("norm")
    runs = F.explode(F.flatten(F.array(*[F.transform(F.array_distinct(own(q)), lambda g: F.xxhash64(g)) for q in RUNS])))
    asked = quotes.select("meeting_id", "id", n.alias("n"), runs.alias("gram"))
    asking = asked.groupBy("meeting_id", "gram").agg(F.count("*").alias("texts"))
    of = F.lit(None).cast("array<string>")
    for q in RUNS:
        of = F.when(F.col("run") == q, own(q)).otherwise(of)
    d = lines.select("meeting_id", F.col("id").alias("position"), n.alias("m"), "sure", of.alias("grams"))
    d = d.select("meeting_id", "position", "m", (F.size("grams") - F.col("sure") + 1).alias("prefix"), F.explode(F.transform(F.array_distinct("grams"), lambda g: F.xxhash64(g))).alias("gram"))
    fewest = Window.partitionBy("meeting_id", "position").orderBy(F.coalesce("texts", F.lit(0)), "gram")
    kept = _met(d, asking, ["meeting_id", "gram"], "left").withColumn("r", F.row_number().over(fewest)).filter("r <= prefix AND texts IS NOT NULL")
    near = 2 * F.least("n", "m") >= fuzzy * (F.col("n") + F.col("m")) - SLACK
    pairs = _met(kept.drop("texts", "r", "prefix"), asked, ["meeting_id", "gram"]).filter(near).select("meeting_id", "id", "position").distinct()
    pairs = _met(pairs, quotes.select("meeting_id", "id", F.col("norm").alias("needle")), ["meeting_id", "id"])
    pairs = _met(pairs, lines.select("meeting_id", F.col("id").alias("position"), F.col("norm").alias("hay")), ["meeting_id", "position"])
    return pairs.select("meeting_id", "id", "position", "needle", "hay")


def _by_pairs(quotes: DataFrame, lines: DataFrame, fuzzy: float) -> DataFrame:
    """Alike candidates by letter pairs.

    Let n and m be the lengths, L = n + m, and M the matched letters: fuzzy <= 2 M / L. The stretches are at most
    L - 2 M + 1, as an unmatched letter lies between two of them; so both texts have at least 3 M - L - 1 pairs of
    neighbouring letters in common, 5 M - 2 L - 2 triples, and M letters. Above five sixths the first is positive for all
    but equal texts, so it finds the candidates; all three are then counted.
    """

    def side(d, which):
        _, two, three = _grams(F.col("norm"))
        return d.select("meeting_id", F.lit(which).alias("side"), "id", "norm", F.length("norm").alias("n"), F.array_distinct(two).alias("grams"), F.array_distinct(three).alias("triples"), _bag(F.col("norm")).alias("bag"))

    def of(d, which, **names):
        return d.filter(F.col("side") == which).select("meeting_id", *[F.col(a).alias(b) for a, b in names.items()])

    both = materialise(side(quotes, 0).unionByName(side(lines, 1)), "quotes-sides")
    grams = both.select("meeting_id", "side", "id", "n", F.explode("grams").alias("gram"))
    held = grams.groupBy("meeting_id", "gram").agg(F.count("*").alias("texts"))
    shared = F.greatest(F.lit(1), F.ceil((1.5 * fuzzy - 1) * 2 / (2 - fuzzy) * F.col("n") - 1 - SLACK))  # for the shortest partner
    rarest = Window.partitionBy("meeting_id", "side", "id").orderBy("texts", "gram")
    kept = _met(grams, held, ["meeting_id", "gram"]).withColumn("r", F.row_number().over(rarest)).filter(F.col("r") <= F.col("n") - shared)
    near = 2 * F.least("n", "m") >= fuzzy * (F.col("n") + F.col("m")) - SLACK
    pairs = _met(of(kept, 0, gram="gram", id="id", n="n"), of(kept, 1, gram="gram", id="position", n="m"), ["meeting_id", "gram"]).filter(near)
    pairs = pairs.select("meeting_id", "id", "position").distinct()
    pairs = _met(pairs, of(both, 0, id="id", norm="needle", n="n", grams="g2", triples="g3", bag="g1"), ["meeting_id", "id"])
    pairs = _met(pairs, of(both, 1, id="position", norm="hay", n="m", grams="h2", triples="h3", bag="h1"), ["meeting_id", "position"])
    total = F.col("n") + F.col("m")
    matched = F.ceil(fuzzy / 2 * total - SLACK)

    def common(size, least):
        repeated = F.least(F.col("n") - size + 1 - F.size(f"g{size}"), F.col("m") - size + 1 - F.size(f"h{size}"))  # runs beyond the distinct ones
        return F.size(F.array_intersect(f"g{size}", f"h{size}")) >= least - repeated

    enough = common(3, 5 * matched - 2 * total - 2) & common(2, 3 * matched - total - 1) & common(1, matched)
    return pairs.filter(enough).select("meeting_id", "id", "position", "needle", "hay")


def _common(a: str, b: str) -> int:
    """The length of the longest common subsequence: a bit for each letter of a, a step for each of b."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _held(a: str, b: str, rare: set[str], need: int) -> int:
    """How many letters of b lie in equal stretches of a and b that hold one of the letters `rare`, or start both texts; or a bound on it below `need`.

    A stretch that reaches back over a rare letter was found there, so up to the last rare letter no more letters are gained.
    """
    m = len(b)
    at: dict[str, list[int]] = {}
    for i, c in enumerate(a, 1):
        if c in rare:
            at.setdefault(c, []).append(i)
    a, b = f"\ud800{a}\ud800", f"\udc00{b}\udc00"  # ends that equal no letter
    start = 1
    while a[start] == b[start]:
        start += 1
    kept = bytearray(b"\1" * start + bytes(m + 1 - start))
    ends: dict[int, int] = {}  # of the last stretch on each diagonal
    lost, seen = 0, 1
    for j in [j for j, c in enumerate(b) if c in rare]:
        for i in at.get(b[j], ()):
            if ends.get(i - j, 0) > j:
                continue
            after = j + 1
            d = i - j
            while a[after + d] == b[after]:
                after += 1
            before = j
            while a[before + d - 1] == b[before - 1]:
                before -= 1
            ends[d] = after
            kept[before:after] = b"\1" * (after - before)
        lost += kept.count(0, seen, j + 1)
        seen = j + 1
        if m - lost < need:
            return m - lost
    return m - lost - kept.count(0, seen)


def most_matched(a: str, b: str, need: int = 0) -> int:
    """A bound on the letters that difflib.SequenceMatcher(None, a, b) matches, exact enough to compare with `need`.

    In a text b of LOOKED_UP letters or more it looks up no letter that makes up over 1 % of b, so a matched stretch holds a
    rarer one or starts both texts. In a shorter one the matched stretches are a common subsequence.
    """
    if len(b) < LOOKED_UP:
        return _common(a, b)
    return _held(a, b, {c for c, k in Counter(b).items() if k <= len(b) // 100 + 1}, need)


def sequence_ratio(a: str | None, b: str | None, fuzzy: float) -> float:
    """The sequence ratio of two texts, 0 where it is under `fuzzy` or a text is null."""
    if a is None or b is None:
        return 0.0
    need = ceil(fuzzy / 2 * (len(a) + len(b)) - SLACK)
    if most_matched(a, b, need) < need:
        return 0.0
    ratio = SequenceMatcher(None, a, b).ratio()
    return ratio if ratio >= fuzzy else 0.0


def _ratio(fuzzy: float):
    """sequence_ratio of two columns."""

    @F.pandas_udf("double")
    def ratio(a, b):
        import pandas as pd

        return pd.Series([sequence_ratio(x, y, fuzzy) for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio


def _most_alike(fuzzy: float):
    """The index of the text in an array that is most alike to a text, the first of equals; null if none is `fuzzy` alike."""

    @F.pandas_udf("int")
    def most_alike(text, others):
        import pandas as pd

        def best(x, ys):
            ratios = [sequence_ratio(x, y, fuzzy) for y in (() if ys is None else ys)]
            top = max(ratios, default=0.0)
            return ratios.index(top) if top else None

        return pd.Series([best(x, ys) for x, ys in zip(text, others, strict=True)], dtype="Int32")

    return most_alike


def _alike(quotes: DataFrame, lines: DataFrame, fuzzy: float) -> DataFrame:
    found = alike_candidates(quotes, lines, fuzzy).withColumn("ratio", _ratio(fuzzy)("needle", "hay")).filter(F.col("ratio") >= fuzzy)
    return found.groupBy("meeting_id", "id").agg(F.max_by("position", F.struct("ratio", -F.col("position"))).alias("near"))


def _shares(overlap: float) -> Column:
    """Whether a line has `overlap` of a quote's tokens."""
    n = F.size("words")
    return (n >= 2) & (F.size("heard") >= F.ceil(F.lit(overlap) * n - SLACK)) & (F.size(F.array_intersect("words", "heard")) / n >= overlap)


def _items(read: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """What was found for a class, for each of its quotes."""
    return _met(read.withColumnRenamed("id", "item"), _met(classes, found, ["meeting_id", "id"]), ["meeting_id", "norm", "words"]).drop("id", "norm", "words")


def _contained_items(read: DataFrame, heard: DataFrame, lines: DataFrame) -> DataFrame:
    few, asked, said = _by_size(read, heard, lines)
    inside = F.contains("hay", F.col("norm")) | F.contains("norm", F.col("hay"))
    small = _meet(read, few, inside).groupBy("meeting_id", F.col("id").alias("item")).agg(F.min("position").alias("position"))
    q, said = _classes(asked), _classes(said)
    return small.unionByName(_items(asked, q, _contained(q, said)))


def contained_quotes(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    """Quotes (meeting_id, item, quote) with the first line's position that contains them or that they contain, once normalised."""
    found = _contained_items(_read(quotes, "item", "quote"), _read(lines, "position", "text"), lines)
    return _met(quotes, found, ["meeting_id", "item"], "left")


def shared_quotes(quotes: DataFrame, lines: DataFrame, overlap: float = 0.65) -> DataFrame:
    """Quotes with `shared`: whether they have two tokens or more and a line has `overlap` of them."""
    _check(overlap=overlap)
    read = _read(quotes, "item", "quote")
    few, asked, said = _by_size(read, _read(lines, "position", "text"), lines)
    q, said = _classes(asked), _classes(said)
    found = _meet(read, few, _shares(overlap), "left_semi").select("meeting_id", F.col("id").alias("item"))
    found = found.unionByName(_items(asked, q, _shared(q, said, overlap))).withColumn("shared", F.lit(True))
    return _met(quotes, found, ["meeting_id", "item"], "left").withColumn("shared", F.coalesce("shared", F.lit(False)))


def _small_matches(quotes: DataFrame, lines: DataFrame, fuzzy: float, overlap: float) -> DataFrame:
    """quote_matches in small meetings: a quote meets all lines of its meeting as one row, so each text is shuffled once and no pair is a row."""
    heard = _read(lines, "position", "text").filter("meeting_id IS NOT NULL").select("meeting_id", F.struct(F.col("id").alias("position"), F.col("norm").alias("hay"), F.length("norm").alias("m"), F.col("words").alias("heard")).alias("line"))
    said = heard.groupBy(F.col("meeting_id").alias("of")).agg(F.array_sort(F.collect_list("line")).alias("said"))
    norm = F.nullif(X.normalise(F.col("quote")), F.lit(""))
    read = quotes.withColumns({"norm": norm, "words": F.array_distinct(X.tokens(F.col("quote")))}).withColumns({"n": F.length("norm"), "least": F.ceil(F.lit(overlap) * F.size("words") - SLACK)})
    d = _met(read, said, F.col("meeting_id") == F.col("of"), "left")
    keep = [F.col(c) for c in quotes.columns]
    inside = F.filter("said", lambda s: F.contains(s["hay"], F.col("norm")) | F.contains(F.col("norm"), s["hay"]))
    d = d.select(*keep, "norm", "words", "n", "least", "said", F.try_element_at(inside, F.lit(1))["position"].alias("first"))
    left = F.col("first").isNull() & F.col("norm").isNotNull() & F.col("said").isNotNull()
    shares = F.exists("said", lambda s: (F.size(s["heard"]) >= F.col("least")) & (F.size(F.array_intersect("words", s["heard"])) / F.size("words") >= overlap))
    near = F.filter("said", lambda s: 2 * F.least(F.col("n"), s["m"]) >= fuzzy * (F.col("n") + s["m"]) - SLACK)
    d = d.select(*keep, "norm", "first", F.when(left & (F.size("words") >= 2), shares).otherwise(F.lit(False)).alias("shared"), F.when(left, near).alias("near"))
    d = d.select(*keep, "first", "shared", F.when(F.size("near") > 0, F.col("norm")).alias("norm"), F.col("near.position").alias("positions"), F.col("near.hay").alias("hays"))
    d = d.withColumn("best", _most_alike(fuzzy)("norm", "hays"))
    source = F.coalesce("first", F.try_element_at("positions", F.col("best") + 1))
    return d.select(*keep, (F.col("shared") | source.isNotNull()).alias("verified"), source.alias("source_position"))


def _large_matches(quotes: DataFrame, lines: DataFrame, fuzzy: float, overlap: float) -> DataFrame:
    """quote_matches by the three rules of the join; only quotes that containment leaves open are compared further."""
    read, said = materialise(_read(quotes, "item", "quote"), "quotes-read"), materialise(_classes(_read(lines, "position", "text")), "quotes-said")
    q = _classes(read)
    inside = materialise(_items(read, q, _contained(q, said)), "quotes-contained")
    left = _met(read, inside.select("meeting_id", F.col("item").alias("id")), ["meeting_id", "id"], "left_anti")
    q = materialise(_classes(left), "quotes-left")
    near = _items(left, q, _met(_alike(q, said, fuzzy), _shared(q, said, overlap), ["meeting_id", "id"], "full"))
    source = F.col("near").cast(inside.schema["position"].dataType).alias("source_position")
    found = inside.select("meeting_id", "item", F.col("position").alias("source_position")).unionByName(near.select("meeting_id", "item", source))
    out = _met(quotes, found.withColumn("verified", F.lit(True)), ["meeting_id", "item"], "left")
    return out.select(*quotes.columns, F.coalesce("verified", F.lit(False)).alias("verified"), "source_position")


def quote_matches(quotes: DataFrame, lines: DataFrame, fuzzy: float = 0.85, overlap: float = 0.65) -> DataFrame:
    """Whether each quote (meeting_id, item, quote) was said: verified, and the line it comes from.

    A line bears a quote out if either contains the other once normalised, if their sequences are `fuzzy` alike, or if
    it has `overlap` of the quote's tokens, two at least. The source is the first containing line, else the most alike
    one from `fuzzy` on. The sequence ratio runs in Python only for pairs that most_matched leaves open. Items are unique in
    a meeting, as positions are. Null and empty quotes, quotes without a meeting and those of meetings without lines are not
    verified.
    """
    _check(fuzzy, overlap)
    large = lines.groupBy("meeting_id").agg(F.count("*").alias("n")).filter(F.col("n") > SMALL).select("meeting_id")
    large = materialise(large, "quotes-large")
    if large.isEmpty():
        return _small_matches(quotes, lines, fuzzy, overlap)
    few, many = [[d.join(large, "meeting_id", how).select(*d.columns) for d in (quotes, lines)] for how in ("left_anti", "left_semi")]
    return _small_matches(*few, fuzzy, overlap).unionByName(_large_matches(*many, fuzzy, overlap))
