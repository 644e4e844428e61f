"""Speaker turns: greedy merging, noise smoothing, phrase dedup, summary windows, numbering.

Rules that hang on order are folds over each meeting's sorted lines, which stream; the only shuffle is by meeting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import text as X
from parley.helpers import with_fold

GAP_MS, CAP_MS, WINDOW_MS = 2_500, 120_000, 180_000


def number_turns(lines: DataFrame, gap_ms: int = GAP_MS, cap_ms: int | None = CAP_MS) -> DataFrame:
    """lines (meeting_id, position, start_ms, end_ms, speaker_label, ...) with the number of their turn, from 0.

    A line goes on with a turn if its label is the same, it starts at most gap_ms after the turn's last line
    ends, and it ends at most cap_ms after the turn starts. The cap makes this a fold, not gaps and islands;
    without a cap a window does.
    """
    if cap_ms is None:
        w = Window.partitionBy("meeting_id").orderBy("start_ms", "position")
        new = (F.lag("speaker_label").over(w).isNull() | (F.lag("speaker_label").over(w) != F.col("speaker_label")) | (F.col("start_ms") - F.lag("end_ms").over(w) > gap_ms)).cast("int")
        return lines.withColumn("_new", new).withColumn("turn", (F.sum("_new").over(w) - 1).cast("int")).drop("_new")

    def step(z, start, end, label):
        turn, last, began, ended = z
        joined = turn >= 0 and last == label and start - ended <= gap_ms and end - began <= cap_ms
        z = (turn, label, began, end) if joined else (turn + 1, label, start, end)
        return z, z[0]

    return with_fold(lines, "meeting_id", ["start_ms", "position"], ["start_ms", "end_ms", "speaker_label"], (-1, None, 0, 0), step, "turn", T.IntegerType())


def roll_up(numbered: DataFrame) -> DataFrame:
    """Numbered lines to turns: first and last values, talk time, participants in order, language by talk time."""
    order = F.struct("start_ms", "position")
    speakers = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "position", F.coalesce("candidate_speakers", F.array().cast("array<string>")).alias("c")))), lambda x: x["c"])))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "position", F.col("text").alias("t")))), lambda x: x["t"])
    turns = numbered.groupBy("meeting_id", "turn").agg(
        F.min_by("speaker_label", order).alias("speaker_label"), F.min_by("speaker", order).alias("speaker"), F.min("start_ms").alias("start_ms"),
        F.max_by("end_ms", order).alias("end_ms"), F.count("*").cast("int").alias("segments"), F.bool_or("is_overlap").alias("is_overlap"),
        speakers.alias("candidate_speakers"), texts.alias("parts"),
    )
    turns = turns.withColumn("raw_text", X.collapse(F.array_join(dedup_phrases(F.col("parts")), " "))).drop("parts")
    return turns.withColumn("text", X.tidy(F.col("raw_text"))).join(turn_language(numbered), ["meeting_id", "turn"], "left")


def turn_language(numbered: DataFrame) -> DataFrame:
    """The language that a turn is mostly spoken in: by time, then lines, then first heard; and all in first-heard order."""
    heard = numbered.filter("language IS NOT NULL").groupBy("meeting_id", "turn", "language").agg(
        F.sum(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).alias("ms"), F.count("*").alias("n"), F.min(F.struct("start_ms", "position")).alias("at")
    )
    w = Window.partitionBy("meeting_id", "turn").orderBy(F.desc("ms"), F.desc("n"), "at")
    first = F.transform(F.array_sort(F.collect_list(F.struct("at", "language"))), lambda x: x["language"])
    return heard.withColumn("r", F.row_number().over(w)).groupBy("meeting_id", "turn").agg(F.max(F.when(F.col("r") == 1, F.col("language"))).alias("language"), first.alias("languages"))


def dedup_phrases(parts: Column) -> Column:
    """Consecutive texts without what repeats: equal or contained ones go, a containing one replaces, an overlap of 3 words or more is cut."""
    clean = F.filter(F.transform(parts, X.collapse), lambda p: p != "")
    lowered = lambda w: F.transform(w, lambda x: F.lower(x))

    def step(z: Column, p: Column) -> Column:
        last = F.coalesce(F.try_element_at(z, F.lit(-1)), F.lit(""))
        a, b = F.split(last, " "), F.split(p, " ")
        most = F.least(F.size(a), F.size(b))
        sizes = F.when(most >= 3, F.sequence(F.lit(3), most)).otherwise(F.array().cast("array<int>"))
        overlap = F.aggregate(sizes, F.lit(0), lambda k, n: F.when(lowered(F.slice(a, F.size(a) - n + 1, n)) == lowered(F.slice(b, F.lit(1), n)), n).otherwise(k))
        rest = F.array_join(F.slice(b, overlap + 1, F.size(b)), " ")
        return (
            F.when(F.size(z) == 0, F.array(p))
            .when(F.contains(last, p), z)
            .when(F.contains(p, last), F.concat(F.slice(z, F.lit(1), F.size(z) - 1), F.array(p)))
            .when(rest == "", z)
            .otherwise(F.concat(z, F.array(rest)))
        )

    return F.aggregate(clean, F.array().cast("array<string>"), step)


def merge_turns(lines: DataFrame, gap_ms: int = GAP_MS, cap_ms: int | None = CAP_MS) -> DataFrame:
    """Noise smoothed, lines merged into turns and rolled up."""
    return roll_up(number_turns(smooth_noise(lines), gap_ms, cap_ms))


def smooth_noise(lines: DataFrame) -> DataFrame:
    """Lines that are one noise take the label before them, as it then is, or else the label after them, as label and as speaker.

    Of two lines that are a whole meeting, a noise takes the other's label and speaker, the second before the first.
    """
    w = Window.partitionBy("meeting_id").orderBy("start_ms", "position")
    noise = X.is_noise(F.col("text"))
    own = F.coalesce(F.nullif("speaker_label", F.lit("")), F.nullif("speaker", F.lit("")))
    real = F.when(~noise, own)
    before = F.last(real, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # a leading noise takes the next line's own label, and the noises after it take what it took
    opening = F.first(own).over(w.rowsBetween(1, 1))
    first = F.first(F.struct("position")).over(w)["position"] == F.col("position")
    lead = F.first(F.when(first & noise, opening), ignorenulls=True).over(w)
    label = F.when(noise, F.coalesce(before, lead, own)).otherwise(own)
    other = F.struct(noise.alias("noise"), own.alias("own"), "speaker", "speaker_label")
    n = F.count("*").over(Window.partitionBy("meeting_id"))
    d = lines.withColumns({
        "_noise": noise, "_own": own, "_label": label, "_n": n, "_prev": F.lag(other).over(w), "_next": F.lead(other).over(w),
    })
    two, second = F.col("_n") == 2, F.col("_prev").isNotNull()
    by_first = two & second & F.col("_noise") & F.col("_prev.own").isNotNull()
    by_second = two & ~second & F.col("_noise") & ~F.col("_next.noise") & F.col("_next.own").isNotNull()
    many = (F.col("_n") > 2) & F.col("_noise") & (F.col("_label") != F.col("_own"))
    new_label = F.when(by_first, F.col("_prev.own")).when(by_second, F.col("_next.own")).when(many, F.col("_label")).otherwise(F.col("speaker_label"))
    new_speaker = F.when(by_first, F.col("_prev.speaker")).when(by_second, F.col("_next.speaker")).when(many, F.col("_label")).otherwise(F.col("speaker"))
    new = {"speaker_label": new_label, "speaker": new_speaker}
    return d.select(*[new[c].alias(c) if c in new else F.col(c) for c in lines.columns])


def summary_windows(lines: DataFrame, width_ms: int = WINDOW_MS) -> DataFrame:
    """lines with the number of their summary window; a window opens at its first line and lasts width_ms."""

    def step(z, start):
        win, began = z
        z = (win + 1, start) if win < 0 or start - began >= width_ms else z
        return z, z[0]

    return with_fold(lines, "meeting_id", ["start_ms", "position"], ["start_ms"], (-1, 0), step, "summary_window", T.IntegerType())


def first_appearance(lines: DataFrame, palette: int = 10) -> DataFrame:
    """Labels of each meeting numbered and coloured in order of their first line."""
    first = lines.groupBy("meeting_id", "speaker_label").agg(F.min("position").alias("first_position"))
    rank = F.row_number().over(Window.partitionBy("meeting_id").orderBy("first_position")) - 1
    return first.withColumn("speaker_no", rank).withColumn("palette_slot", F.pmod("speaker_no", F.lit(palette)).cast("int"))


def previous_human(lines: DataFrame) -> DataFrame:
    """For each generic label the last named speaker before its first line."""
    w = Window.partitionBy("meeting_id").orderBy("position")
    named = F.last(F.when(~X.is_generic(F.col("speaker")), F.col("speaker")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = lines.withColumn("previous", named).filter(X.is_generic(F.col("speaker")))
    return marked.groupBy("meeting_id", "speaker_label").agg(F.min("position").alias("first_position"), F.min_by("previous", "position").alias("previous_speaker"))


def running_language(lines: DataFrame, codes: tuple[str, ...] = ("en", "hi", "mr")) -> DataFrame:
    """The language most lines so far are in, ties to the one heard first; English at the start."""
    so_far = Window.partitionBy("meeting_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    heard = [F.struct(F.count(F.when(F.col("language") == c, 1)).over(so_far).alias("n"), (-F.coalesce(F.min(F.when(F.col("language") == c, F.col("position"))).over(so_far), F.lit(1 << 30))).alias("at"), F.lit(c).alias("code")) for c in codes]
    top = F.greatest(*heard)
    return lines.withColumn("hint_language", F.when(top["n"] > 0, top["code"]).otherwise("en"))


def in_batches(turns: DataFrame, size: int = 5) -> DataFrame:
    """Turns in neighbouring batches of a fixed size."""
    return turns.withColumn("batch", F.floor(F.col("turn") / size).cast("int"))


def change_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many lines of each meeting changed their label."""
    pairs = before.select("meeting_id", "position", F.col("speaker_label").alias("a")).join(after.select("meeting_id", "position", F.col("speaker_label").alias("b")), ["meeting_id", "position"])
    return pairs.groupBy("meeting_id").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


def clauses(lines: DataFrame) -> DataFrame:
    """Clauses of a line with several speakers, dealt to them in turn."""
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?,;।])\s+"), lambda s: F.btrim(s)), lambda s: s != "")
    people = X.split_composite(F.col("speaker"))
    d = lines.withColumn("people", people).filter(F.size("people") > 1).select("meeting_id", "position", "people", F.posexplode(parts).alias("clause_no", "clause"))
    return d.select("meeting_id", "position", "clause_no", "clause", F.element_at("people", F.pmod("clause_no", F.size("people")) + 1).alias("speaker"))


def language_fallback(lines: DataFrame, codes: tuple[str, ...] = ("en", "hi", "mr")) -> DataFrame:
    """Lines in a language that is not supported given the one most lines so far are in; language_fallback says so."""
    d = running_language(lines, codes)
    odd = ~F.coalesce(F.col("language").isin(*codes), F.lit(False))
    return d.withColumns({"language": F.when(odd, F.col("hint_language")).otherwise(F.col("language")), "language_fallback": odd}).drop("hint_language")


def missing_languages(seen: DataFrame, codes: tuple[str, ...] = ("en", "hi", "mr")) -> DataFrame:
    """Allowed languages that a model's labels (code) lack, which it can therefore never find."""
    allowed = seen.sparkSession.createDataFrame([(c,) for c in codes], "code string")
    return allowed.join(seen.select("code").distinct(), "code", "left_anti")
