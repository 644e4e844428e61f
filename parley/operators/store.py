"""Changes to stored meetings, each a DataFrame to a DataFrame, and the constraint checks that Spark does not make."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as X

ZEROED = ("file_size_bytes", "progress", "failed_segments", "participants")


def insert(meetings: DataFrame, records: DataFrame) -> DataFrame:
    """meetings with further rows; missing columns are null."""
    return meetings.unionByName(records, allowMissingColumns=True)


def update(meetings: DataFrame, key, **fields) -> DataFrame:
    """One meeting's given fields set; a null among the four counters is stored as 0."""
    hit = F.col("id") == key
    change = {c: F.when(hit, F.lit(0 if v is None and c in ZEROED else v)).otherwise(F.col(c)).cast(meetings.schema[c].dataType) for c, v in fields.items()}
    return meetings.withColumns(change)


def replace_children(children: DataFrame, new: DataFrame, key_col: str = "meeting_id") -> DataFrame:
    """All children of the parents that occur in `new` give way to it."""
    return children.join(new.select(key_col).distinct(), key_col, "left_anti").unionByName(new, allowMissingColumns=True)


def dedup_keywords(rows: DataFrame) -> DataFrame:
    """One row per meeting and word: counts summed, in first-seen order."""
    d = rows.groupBy("meeting_id", "word").agg(F.sum("count").alias("count"), F.min("position").alias("first"))
    return d.select("meeting_id", "word", "count", (F.row_number().over(Window.partitionBy("meeting_id").orderBy("first")) - 1).alias("position"))


def soft_delete(meetings: DataFrame, keys: Column, at: str) -> DataFrame:
    """Matching active meetings marked as deleted."""
    return meetings.withColumn("deleted_at", F.when(keys & F.col("deleted_at").isNull(), F.lit(at).cast("timestamp")).otherwise(F.col("deleted_at")))


def restore(meetings: DataFrame, keys: Column) -> DataFrame:
    """Matching deleted meetings active again."""
    return meetings.withColumn("deleted_at", F.when(~keys, F.col("deleted_at")))


def purge(meetings: DataFrame, children: list[DataFrame], keys: Column | None = None) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(meetings left, children left, one row with the number purged): matching trashed meetings go for good, or the whole trash."""
    gone = F.col("deleted_at").isNotNull() & (keys if keys is not None else F.lit(True))
    left = meetings.filter(~gone)
    ids = left.select(F.col("id").alias("meeting_id"))
    return left, [c.join(ids, "meeting_id", "left_semi") for c in children], meetings.filter(gone).agg(F.count("*").alias("purged"))


def rename_speaker(lines: DataFrame, old: str, new: str, meeting=None) -> DataFrame:
    """A speaker renamed, also inside composites and candidate lists; a blank name changes nothing."""
    if not (new or "").strip():
        return lines
    swap = lambda x: F.when(x == old, new.strip()).otherwise(x)
    parts = F.transform(F.split("speaker", r" \+ "), swap)
    here = F.lit(True) if meeting is None else F.col("meeting_id") == meeting
    change = {"speaker": F.when(here, F.array_join(parts, " + ")).otherwise(F.col("speaker"))}
    if "candidate_speakers" in lines.columns:
        change["candidate_speakers"] = F.when(here, F.transform("candidate_speakers", swap)).otherwise(F.col("candidate_speakers"))
    return lines.withColumns(change)


def merge_stats(stats: DataFrame) -> DataFrame:
    """Stat rows that share a name after a rename, merged in first-seen order."""
    d = stats.groupBy("meeting_id", "name").agg(F.sum("ms").alias("ms"), F.min("position").alias("first"))
    w = Window.partitionBy("meeting_id")
    return d.select("meeting_id", "name", "ms", F.round(100 * F.col("ms") / F.sum("ms").over(w), 1).alias("pct"), (F.row_number().over(w.orderBy("first")) - 1).alias("position"))


def delete_speaker(lines: DataFrame, who: str, meeting=None) -> DataFrame:
    """A speaker's lines removed, matched by name or label whatever the case."""
    hit = (F.lower(F.trim("speaker")) == who.strip().lower()) | (F.lower(F.trim("speaker_label")) == who.strip().lower())
    here = F.lit(True) if meeting is None else F.col("meeting_id") == meeting
    return lines.filter(~(F.coalesce(hit, F.lit(False)) & here))


def revert_speaker(lines: DataFrame, name: str) -> DataFrame:
    """A display name taken back everywhere: to the label, or Speaker_00 where the label is the name itself."""
    back = F.when(F.col("speaker_label") != name, F.col("speaker_label")).otherwise("Speaker_00")
    return lines.withColumn("speaker", F.when(F.col("speaker") == name, back).otherwise(F.col("speaker")))


def set_identification(lines: DataFrame, who: str, name: str, confidence: float) -> DataFrame:
    """Identification written to the lines of a speaker or label."""
    hit = (F.col("speaker") == who) | (F.col("speaker_label") == who)
    kept = F.col("identified_as") if "identified_as" in lines.columns else F.lit(None).cast("string")
    sure = F.col("confidence") if "confidence" in lines.columns else F.lit(None).cast("double")
    return lines.withColumns({"identified_as": F.when(hit, name).otherwise(kept), "confidence": F.when(hit, F.lit(confidence)).otherwise(sure)})


def reassign(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """Lines renamed by start time: changes (meeting_id, start_sec, new_speaker, new_label, seq).

    The last change of a start (to two decimals) wins; blank names are skipped; a new name without a label
    gets the meeting's next free Speaker_NN, in order of line.
    """
    key = lambda c: F.round(c, 2)
    named = changes.filter("new_speaker IS NOT NULL AND trim(new_speaker) <> ''").groupBy("meeting_id", key(F.col("start_sec")).alias("k")).agg(F.max_by("new_speaker", "seq").alias("to"), F.max_by("new_label", "seq").alias("to_label"))
    d = lines.withColumn("k", key(F.col("start_ms") / 1000)).join(named, ["meeting_id", "k"], "left")
    number = F.try_to_number(F.nullif(F.regexp_extract("speaker_label", r"(\d+)$", 1), F.lit("")), F.lit("999999")).cast("int")
    top = F.max(number).over(Window.partitionBy("meeting_id"))
    fresh = F.col("to").isNotNull() & F.col("to_label").isNull()
    first = F.min(F.when(fresh, F.col("position"))).over(Window.partitionBy("meeting_id", "to"))
    d = d.withColumn("top", F.coalesce(top, F.lit(-1))).withColumn("first", first).withColumn("fresh", fresh)
    order = F.sum((F.col("fresh") & (F.col("position") == F.col("first"))).cast("int")).over(Window.partitionBy("meeting_id").orderBy("position"))
    d = d.withColumn("ord", order).withColumn("nth", F.min(F.when(F.col("fresh"), F.col("ord"))).over(Window.partitionBy("meeting_id", "to")))
    label = F.when(F.col("fresh"), F.format_string("Speaker_%02d", F.col("top") + F.col("nth"))).when(F.col("to").isNotNull(), F.col("to_label")).otherwise(F.col("speaker_label"))
    return d.select(*[F.coalesce("to", "speaker").alias("speaker") if c == "speaker" else label.alias("speaker_label") if c == "speaker_label" else F.col(c) for c in lines.columns])


def enroll(profiles: DataFrame, samples: DataFrame, overwrite: bool = False) -> DataFrame:
    """Voice profiles (name, centroid, sample_count) with samples (name, embedding) blended in.

    Names match in any case and are title-cased if Latin. A known voice becomes the weighted mean at length 1
    and counts one more; overwrite starts it anew. created and overwritten say what happened.
    """
    from parley.functions.scalar import unit

    new = samples.select(X.person_name(F.col("name")).alias("new_name"), unit(F.col("embedding")).alias("e")).filter("new_name IS NOT NULL").dropDuplicates(["new_name"])
    d = profiles.join(new, F.lower("name") == F.lower("new_name"), "full_outer")
    n = F.col("sample_count")
    blended = unit(F.zip_with(F.col("centroid").cast("array<double>"), "e", lambda c, e: (c * n + e) / (n + 1)))
    known, sampled = F.col("name").isNotNull(), F.col("e").isNotNull()
    centroid = F.when(~sampled, F.col("centroid").cast("array<double>")).when(known & F.lit(not overwrite), blended).otherwise(F.col("e"))
    count = F.when(~sampled, n).when(known & F.lit(not overwrite), n + 1).otherwise(F.lit(1))
    return d.select(F.coalesce("name", "new_name").alias("name"), centroid.alias("centroid"), count.alias("sample_count"), (~known).alias("created"), (known & sampled & F.lit(overwrite)).alias("overwritten"))


def remove_profile(profiles: DataFrame, name: str) -> DataFrame:
    return profiles.filter(F.col("name") != name)


def profile_stamp(profiles: DataFrame) -> DataFrame:
    """What changes when any profile does."""
    return profiles.agg(F.count("*").alias("profiles"), F.max("updated_at").alias("updated_at"))


#: What a fresh upload starts with; columns that a table lacks are left out.
FRESH = {
    "status": "Processing", "progress": 0, "error": None, "audio_quality_warning": None, "failed_segments": None, "duration": None, "duration_seconds": None,
    "participants": None, "language": None, "summary": None, "summary_engine": None, "insights": None, "stt_provider": None,
}


def reset_for_upload(meetings: DataFrame, key, at: str, children: list[DataFrame] | None = None, **upload) -> tuple[DataFrame, list[DataFrame]]:
    """(meetings with one back to the state of a fresh upload, children without its rows); `upload` gives file columns."""
    known = {c: v for c, v in (FRESH | upload).items() if c in meetings.columns}
    d = update(meetings, key, **known)
    d = d.withColumn("uploaded_at", F.when(F.col("id") == key, F.lit(at).cast("timestamp")).otherwise(F.col("uploaded_at")))
    return d, [c.filter(F.col("meeting_id") != key) for c in children or []]


def requeue_failed(meetings: DataFrame) -> DataFrame:
    """Failed meetings, to be processed again."""
    return meetings.filter("status = 'Failed' AND deleted_at IS NULL").select("id")


def to_summarise(meetings: DataFrame, lines: DataFrame, forced: bool = False) -> DataFrame:
    """Completed meetings with a transcript and no summary yet, or all of these if forced."""
    d = meetings.filter("status = 'Completed'").join(lines.select(F.col("meeting_id").alias("id")).distinct(), "id", "left_semi")
    return d if forced else d.filter("summary IS NULL OR trim(summary) = ''")


def reconcile(incoming: DataFrame, existing: DataFrame, replace: bool = False) -> DataFrame:
    """The rows after an import: known ids are skipped, or replaced."""
    if replace:
        return existing.join(incoming.select("id").distinct(), "id", "left_anti").unionByName(incoming, allowMissingColumns=True)
    return existing.unionByName(incoming.join(existing.select("id"), "id", "left_anti"), allowMissingColumns=True)


def verify_import(source: DataFrame, stored: DataFrame, fields: list[str]) -> DataFrame:
    """Ids whose fields differ between a source and the store, or that only one of them has."""
    a = source.select("id", *[F.col(f).alias(f"a_{f}") for f in fields]).withColumn("in_source", F.lit(True))
    b = stored.select("id", *[F.col(f).alias(f"b_{f}") for f in fields]).withColumn("in_store", F.lit(True))
    d = a.join(b, "id", "full_outer")
    wrong = F.filter(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields]), lambda f: f.isNotNull())
    return d.select("id", F.coalesce("in_source", F.lit(False)).alias("in_source"), F.coalesce("in_store", F.lit(False)).alias("in_store"), wrong.alias("differs")).filter("NOT in_source OR NOT in_store OR size(differs) > 0")


def backfill_texts(lines: DataFrame) -> DataFrame:
    """Raw and cleaned text from text where they are missing."""
    return lines.withColumns({"raw_text": F.coalesce("raw_text", "text"), "cleaned_text": F.coalesce("cleaned_text", "text")})


def violations(meetings: DataFrame, lines: DataFrame) -> DataFrame:
    """(rule, key) of every row that breaks a constraint of the model."""
    say = lambda df, rule, key: df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
    found = [
        say(meetings.groupBy("id").count().filter("count > 1"), "meetings.id unique", "id"),
        say(meetings.filter("status NOT IN ('Processing', 'Completed', 'Failed')"), "meetings.status known", "id"),
        say(meetings.filter("duration_seconds < 0"), "meetings.duration_seconds not negative", "id"),
        say(lines.groupBy("meeting_id", "position").count().filter("count > 1"), "lines.position unique", "meeting_id"),
        say(lines.filter("end_ms < start_ms"), "lines.end after start", "meeting_id"),
        say(lines.join(meetings.select(F.col("id").alias("meeting_id")), "meeting_id", "left_anti"), "lines.meeting exists", "meeting_id"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out


def documents(meetings: DataFrame, lines: DataFrame) -> DataFrame:
    """Meetings as nested documents with their lines in order; the line count comes along, so a list may drop the lines."""
    each = lines.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("position", "start_ms", "end_ms", "speaker", "text"))).alias("transcript"))
    d = meetings.join(each, F.col("id") == F.col("meeting_id"), "left").drop("meeting_id")
    return d.withColumn("transcript", F.coalesce("transcript", F.array().cast(each.schema["transcript"].dataType))).withColumn("line_count", F.size("transcript"))


def session_dump(lines: DataFrame, stats: DataFrame, languages: DataFrame | None = None, raw: DataFrame | None = None) -> DataFrame:
    """One row per meeting: lines, raw segments, stats, languages and a map of name to time."""
    listed = lambda d, name, *cols: d.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    a = listed(lines, "transcript", "position", "speaker", "text")
    b = stats.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "ms", "pct"))).alias("stats"), F.map_from_entries(F.collect_list(F.struct("name", "ms"))).alias("times"))
    d = a.join(b, "meeting_id", "left").join(listed(raw if raw is not None else lines, "raw_segments", "start_ms", "end_ms", "position", "text"), "meeting_id", "left")
    return d if languages is None else d.join(listed(languages, "languages", "code", "ms", "pct"), "meeting_id", "left")


def export_text(meetings: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, file_name, content): a transcript as text, line by line under its title."""
    from parley.functions.scalar import time_label

    line = X.export_line(time_label(F.col("start_ms") / 1000), F.col("speaker"), F.coalesce("language", F.lit("")), F.coalesce("text", F.lit("")))
    each = lines.select("meeting_id", "position", line.alias("t")).groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("position", "t"))).alias("ts"))
    slug = F.btrim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), F.lit("-"))
    return meetings.join(each, F.col("id") == F.col("meeting_id")).select("id", F.concat(slug, F.lit("-transcript.txt")).alias("file_name"), F.concat_ws("\n", "title", F.array_join(F.transform("ts", lambda x: x["t"]), "\n")).alias("content"))


def overwrite_table(df: DataFrame, path: str) -> None:
    """df in place of the table at path: written beside it first, then the folders are exchanged."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new, old = (jvm.org.apache.hadoop.fs.Path(f"{path}.{tag}-{uuid.uuid4().hex}") for tag in ("new", "old"))
    df.write.parquet(new.toString())
    if fs.exists(to):
        fs.rename(to, old)
    fs.rename(new, to)
    fs.delete(old, True)
