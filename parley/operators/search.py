"""Hybrid search over titles, agendas and lines: whole tokens or a substring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as X


def matches(needle: str, *texts: Column, tokens: bool = True) -> Column:
    """Whether any of the texts contains the needle in any case, or all together hold its tokens as whole tokens."""
    needle = needle.strip().lower()
    hit = reduce(Column.__or__, [F.contains(F.lower(F.coalesce(t, F.lit(""))), F.lit(needle)) for t in texts])
    if not tokens:
        return hit
    wanted = X.words(F.lit(needle))
    found = X.words(F.concat_ws(" ", *texts))
    return hit | ((F.size(wanted) > 0) & F.forall(wanted, lambda w: F.array_contains(found, w)))


def like_escape(needle: str) -> str:
    """A needle that LIKE takes literally, with backslash as the escape."""
    return needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search(meetings: DataFrame, lines: DataFrame, needle: str | None, limit: int = 50, snippets: int = 5, tokens: bool = True) -> DataFrame:
    """The newest active meetings that match, with up to `snippets` of their matching lines.

    Columns: id, title, uploaded_at, status, match_count, hidden, and matches as an array of structs in order
    of position. A meeting that matches by title or agenda alone has none. A blank needle finds nothing.
    """
    if not (needle or "").strip():
        return _shape(meetings.limit(0).withColumns({"match_count": F.lit(0), "matches": F.array().cast("array<struct<position:int,speaker:string,language:string,text:string>>")}))
    hits = lines.filter(matches(needle, F.col("text"), tokens=tokens))
    w = Window.partitionBy("meeting_id").orderBy("position")
    top = hits.withColumn("r", F.row_number().over(w)).groupBy("meeting_id").agg(
        F.count("*").cast("int").alias("match_count"),
        F.array_sort(F.collect_list(F.when(F.col("r") <= snippets, F.struct("position", "speaker", "language", "text")))).alias("matches"),
    )
    joined = meetings.filter("deleted_at IS NULL").join(top, F.col("id") == F.col("meeting_id"), "left")
    by_title = matches(needle, F.col("title"), F.col("agenda"), tokens=tokens)
    found = joined.filter(F.col("match_count").isNotNull() | by_title)
    found = found.withColumn("match_count", F.coalesce("match_count", F.lit(0))).withColumn("matches", F.coalesce("matches", F.array().cast("array<struct<position:int,speaker:string,language:string,text:string>>")))
    return _shape(found.orderBy(F.desc("uploaded_at"), F.desc("id")).limit(limit))


def _shape(found: DataFrame) -> DataFrame:
    return found.select("id", "title", "uploaded_at", "status", "match_count", (F.col("match_count") - F.size("matches")).alias("hidden"), "matches")


def flat_snippets(found: DataFrame) -> DataFrame:
    """One row per snippet."""
    return found.select("id", "match_count", F.posexplode("matches").alias("snippet", "m")).select("id", "match_count", "snippet", "m.*")


def in_meeting(lines: DataFrame, needle: str) -> DataFrame:
    """Lines whose text or raw text contains the needle."""
    raw = F.col("raw_text") if "raw_text" in lines.columns else F.lit("")
    return lines.filter(F.contains(F.lower(F.concat_ws(" ", "text", raw)), F.lit(needle.lower())))


def with_listed(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Listed meetings with their search result, zero where they did not match."""
    counts = found.select("id", F.col("match_count").alias("found"))
    return listed.join(counts, "id", "left").withColumn("match_count", F.coalesce("found", F.lit(0))).drop("found")


def speaker_ranges(lines: DataFrame, name: str | None = None, label: str | None = None) -> DataFrame:
    """Times of the lines that match a name or a label."""
    test = F.lit(False)
    if name:
        test = test | (F.lower(F.trim("speaker")) == name.strip().lower())
    if label:
        test = test | (F.col("speaker_label") == label)
    return lines.filter(test).select("meeting_id", "position", "start_ms", "end_ms")


def inverted_index(lines: DataFrame) -> DataFrame:
    """(token, meeting_id, position): a table that stands in for a text index."""
    return lines.select("meeting_id", "position", F.explode(F.array_distinct(X.words(F.col("text")))).alias("token"))


def term_counts(lines: DataFrame, stop_words: list[str]) -> DataFrame:
    """Tokens of each meeting that are no stop words, counted."""
    d = lines.select("meeting_id", F.explode(X.tokens(F.col("text"))).alias("word"))
    return d.filter(~F.col("word").isin(stop_words)).groupBy("meeting_id", "word").agg(F.count("*").alias("count"))


def keywords(counts: DataFrame, corpus: DataFrame | None = None, top: int = 12, least: int = 2) -> DataFrame:
    """The words that set a meeting apart: tf times ln(N/df) over a background corpus (meeting_id, word), or tf alone.

    Words said twice or more, or all if there is none. N counts the background meetings and one more, df those
    with the word and one more; order is by score, count and word, all descending.
    """
    w = Window.partitionBy("meeting_id")
    d = counts.withColumn("most", F.max("count").over(w)).filter((F.col("count") >= least) | (F.col("most") < least))
    if corpus is None:
        d = d.withColumn("score", F.col("count").cast("double"))
    else:
        n = corpus.select("meeting_id").distinct().agg((F.count("*") + 1).alias("n"))
        df = corpus.select("meeting_id", "word").distinct().groupBy("word").agg(F.count("*").alias("df"))
        d = d.join(df, "word", "left").crossJoin(F.broadcast(n))  # one row
        d = d.withColumn("score", F.round(F.col("count") * F.log(F.col("n") / (F.coalesce("df", F.lit(0)) + 1)), 6))
    rank = F.row_number().over(w.orderBy(F.desc("score"), F.desc("count"), F.desc("word")))
    return d.withColumn("rank", rank).filter(F.col("rank") <= top).select("meeting_id", "word", "count", "score", "rank")


def background(meetings: DataFrame, lines: DataFrame, exclude: int | str, n: int = 20) -> DataFrame:
    """Lines of the n newest active meetings, less the current one if it is among them."""
    ids = meetings.filter("deleted_at IS NULL").orderBy(F.desc("uploaded_at"), F.desc("id")).limit(n).select(F.col("id").alias("meeting_id")).filter(F.col("meeting_id") != exclude)
    return lines.join(F.broadcast(ids), "meeting_id", "left_semi")  # n rows at most
