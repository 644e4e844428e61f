"""Who spoke how long, in which language."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as X

LEAST_GENERIC_MS, LEAST_MS, LEAST_PERCENT, HIDDEN_MS = 5_000, 3_000, 2.0, 50


def shares(lines: DataFrame) -> DataFrame:
    """Talk time per meeting and person: overlapping speech is split equally, unnamed voices under 5 s give way to named ones.

    Returns meeting_id, name, ms, pct (of what remains, one decimal), rank (most time first, then first
    heard), color (of the first line). Lines without duration count for nothing.
    """
    composite = F.col("speaker").rlike(r"\+|&")
    candidates = F.filter(F.coalesce("candidate_speakers", F.array().cast("array<string>")), lambda c: (c != "") & ~c.rlike(r"\+|&"))
    shown = F.when(composite, X.split_composite(F.col("speaker"))).otherwise(F.array(F.coalesce("speaker", "speaker_label")))
    owners = F.when(F.col("is_overlap"), F.when(F.size(candidates) > 0, candidates).otherwise(F.array(F.coalesce("speaker", "speaker_label")))).otherwise(shown)
    d = lines.withColumn("dur", F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).filter("dur > 0").withColumn("owners", owners)
    d = d.select("meeting_id", "position", "color", "dur", F.size("owners").alias("n"), F.posexplode("owners").alias("i", "name"))
    by = d.groupBy("meeting_id", "name").agg(F.sum(F.col("dur") / F.col("n")).alias("ms"), F.min(F.struct("position", "i")).alias("first"), F.min_by("color", F.struct("position", "i")).alias("color"))
    meeting = Window.partitionBy("meeting_id")
    generic = X.is_generic(F.col("name"))
    kept = (
        by.withColumn("named", F.max((~generic).cast("int")).over(meeting))
        .withColumn("keep", ~((F.col("named") == 1) & generic & (F.col("ms") < LEAST_GENERIC_MS)))
        .filter("keep")
    )
    return kept.select(
        "meeting_id", "name", "ms", F.round(100 * F.col("ms") / F.sum("ms").over(meeting), 1).alias("pct"),
        F.row_number().over(meeting.orderBy(F.desc("ms"), "first")).alias("rank"), "color",
    )


def plain_shares(lines: DataFrame) -> DataFrame:
    """Talk time as stored: no splitting, silent speakers kept, in order of first appearance."""
    by = lines.groupBy("meeting_id", F.coalesce("speaker", "speaker_label").alias("name")).agg(F.sum(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).alias("ms"), F.min("position").alias("first"))
    w = Window.partitionBy("meeting_id")
    return by.select("meeting_id", "name", "ms", F.when(F.sum("ms").over(w) > 0, F.round(100 * F.col("ms") / F.sum("ms").over(w), 1)).otherwise(F.lit(0.0)).alias("pct"), (F.row_number().over(w.orderBy("first")) - 1).alias("position"))


def clean_stats(stats: DataFrame, always: bool = False) -> DataFrame:
    """Stored stats with composite names split equally; meetings without any pass through, unless always.

    Most time first, then first heard, then in the order in which a composite names them.
    """
    w = Window.partitionBy("meeting_id")
    d = stats.withColumn("mixed", F.max(F.col("name").rlike(r"\+|&").cast("int")).over(w))
    names = X.split_composite(F.col("name"))
    split = d.filter(F.lit(always) | (F.col("mixed") == 1)).select("meeting_id", "position", F.size(names).alias("n"), "ms", F.posexplode(names).alias("i", "name"))
    summed = split.groupBy("meeting_id", "name").agg(F.sum(F.col("ms") / F.col("n")).alias("ms"), F.min(F.struct("position", "i", "name")).alias("position")).filter("ms > 0")
    rest = d.filter(~(F.lit(always) | (F.col("mixed") == 1))).select("meeting_id", "name", F.col("ms").cast("double").alias("ms"), "position")
    ranked = summed.withColumn("position", F.row_number().over(w.orderBy(F.desc("ms"), "position")) - 1)
    return ranked.select("meeting_id", "name", "ms", "position").unionByName(rest)


def participants(stats: DataFrame) -> DataFrame:
    """How many people took part: 3 s or 2 % of the time each; at least one where anybody spoke."""
    seconds = F.round(F.col("ms") / 1000, 1)
    w = Window.partitionBy("meeting_id")
    d = stats.withColumn("s", seconds).withColumn("share", 100 * F.col("s") / F.sum("s").over(w))
    return d.groupBy("meeting_id").agg(F.greatest(F.count_if((F.col("s") >= LEAST_MS / 1000) | (F.col("share") >= LEAST_PERCENT)), F.lit(1)).alias("participants"))


def distinct_participants(lines: DataFrame) -> DataFrame:
    """How many different names a meeting has, whoever they are."""
    return lines.groupBy("meeting_id").agg(F.countDistinct(F.coalesce(F.nullif("speaker", F.lit("")), "speaker_label")).alias("participants"))


def language_breakdown(lines: DataFrame) -> DataFrame:
    """Talk time by language over unmerged lines; a line in both scripts is split between English and its Indic language by letters.

    Times are added as decimals and read to nine decimals of a millisecond, so no order of addition tips a rounded share.
    """
    d = lines.filter("language IS NOT NULL").withColumn("dur", F.col("end_ms") - F.col("start_ms")).filter("dur > 0")
    lat, dev = X.letters(F.col("text"), "latin"), X.letters(F.col("text"), "devanagari")
    indic = F.when(F.col("language").isin("hi", "mr"), F.col("language")).otherwise("mr")
    part = lambda n: ((F.col("dur") * n).cast("decimal(28,8)") / (lat + dev).cast("decimal(10,0)")).cast("decimal(38,18)")
    parts = F.when((lat > 0) & (dev > 0), F.array(F.struct(F.lit("en").alias("code"), part(lat).alias("ms")), F.struct(indic.alias("code"), part(dev).alias("ms"))))
    parts = parts.otherwise(F.array(F.struct(F.col("language").alias("code"), F.col("dur").cast("decimal(38,18)").alias("ms"))))
    by = d.select("meeting_id", F.explode(parts).alias("x")).groupBy("meeting_id", F.col("x.code").alias("code")).agg(F.sum("x.ms").alias("sum"))
    read = lambda total: F.round(total, 9).cast("double")
    by = by.withColumn("ms", read(F.col("sum"))).withColumn("total", read(F.sum("sum").over(Window.partitionBy("meeting_id"))))
    return by.select("meeting_id", "code", "ms", F.round(100 * F.col("ms") / F.col("total"), 1).alias("pct")).filter(F.col("ms") > HIDDEN_MS)


def dominant_language(lines: DataFrame) -> DataFrame:
    """The language of most lines, ties to the first heard; English without any."""
    by = lines.groupBy("meeting_id", "language").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    key = F.struct(F.when(F.col("language").isNotNull(), F.col("n")).otherwise(F.lit(-1)).alias("n"), (-F.col("first")).alias("at"))
    return by.groupBy("meeting_id").agg(F.coalesce(F.max_by("language", key), F.lit("en")).alias("language"))


def spoken_ms(lines: DataFrame) -> DataFrame:
    """Time spoken, which is not the time from start to end."""
    return lines.groupBy("meeting_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("spoken_ms"), F.count("*").alias("lines"))


def label_totals(lines: DataFrame) -> DataFrame:
    """Time per label."""
    return lines.groupBy("meeting_id", "speaker_label").agg(F.sum(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).alias("ms"))


def dust(lines: DataFrame, least_ms: int = 5_000) -> DataFrame:
    """How many labels each meeting has and how many of them speak under least_ms."""
    return label_totals(lines).groupBy("meeting_id").agg(F.count("*").alias("labels"), F.count_if(F.col("ms") < least_ms).alias("dust"))


def overlap_sweep(lines: DataFrame) -> DataFrame:
    """Overlapping lines of each meeting and how many name their candidates."""
    return lines.groupBy("meeting_id").agg(F.count_if("is_overlap").alias("overlap"), F.count_if(F.col("is_overlap") & (F.size(F.coalesce("candidate_speakers", F.array().cast("array<string>"))) > 1)).alias("with_candidates"))


def script_leaks(lines: DataFrame) -> DataFrame:
    """How many lines of each meeting hold a script that is neither Latin nor Devanagari."""
    from parley.functions.vocabulary import FOREIGN_SCRIPTS

    return lines.groupBy("meeting_id").agg(F.count_if(F.coalesce("text", F.lit("")).rlike(FOREIGN_SCRIPTS)).alias("leaks"))
