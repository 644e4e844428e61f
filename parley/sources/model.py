"""The meeting model over the star-schema test tables, and the model's declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

AS_OF = "2024-01-30 23:59:59"

SPAN = T.StructType([T.StructField(n, T.StringType()) for n in ("speaker", "speaker_label", "text", "color")])
MEETING = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("title", T.StringType()), T.StructField("agenda", T.StringType()),
    T.StructField("file_name", T.StringType()), T.StructField("file_type", T.StringType()), T.StructField("file_size_bytes", T.LongType()),
    T.StructField("uploaded_at", T.TimestampType()), T.StructField("status", T.StringType()), T.StructField("progress", T.IntegerType()),
    T.StructField("error", T.StringType()), T.StructField("failed_segments", T.IntegerType()), T.StructField("duration", T.StringType()),
    T.StructField("duration_seconds", T.DoubleType()), T.StructField("participants", T.IntegerType()), T.StructField("language", T.StringType()),
    T.StructField("summary", T.StringType()), T.StructField("summary_engine", T.StringType()), T.StructField("deleted_at", T.TimestampType()),
    T.StructField("processing_mode", T.StringType()), T.StructField("meeting_type", T.StringType()), T.StructField("department", T.StringType()),
    T.StructField("project_name", T.StringType()), T.StructField("insights", T.StringType()),
])
LINE = T.StructType([
    T.StructField("meeting_id", T.StringType(), False), T.StructField("position", T.IntegerType(), False),
    T.StructField("start_sec", T.DoubleType()), T.StructField("end_sec", T.DoubleType()), T.StructField("time_label", T.StringType()),
    T.StructField("speaker", T.StringType()), T.StructField("speaker_label", T.StringType()), T.StructField("identified_as", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("color", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("language_name", T.StringType()), T.StructField("language_prob", T.DoubleType()), T.StructField("language_fallback", T.BooleanType()),
    T.StructField("language_mix", T.ArrayType(T.StringType())), T.StructField("language_mixed_suspected", T.BooleanType()),
    T.StructField("language_margin", T.DoubleType()), T.StructField("is_overlap", T.BooleanType()),
    T.StructField("candidate_speakers", T.ArrayType(T.StringType())), T.StructField("candidate_labels", T.ArrayType(T.StringType())),
    T.StructField("attributed_spans", T.ArrayType(SPAN)), T.StructField("raw_text", T.StringType()), T.StructField("cleaned_text", T.StringType()),
    T.StructField("text", T.StringType()),
])
PROFILE = T.StructType([T.StructField("name", T.StringType(), False), T.StructField("centroid", T.ArrayType(T.FloatType())), T.StructField("sample_count", T.IntegerType())])

#: Values that a reader supplies where a row has none.
READ_DEFAULTS = {"processing_mode": "local", "meeting_type": "internal", "department": "AI Team", "project_name": ""}
LANGUAGES = [("en", "English"), ("hi", "Hindi"), ("mr", "Marathi")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; NTZ timestamps become instants in UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript lines from `conversations`: integer milliseconds, so sums are exact in any engine."""
    c = table(spark, sf_dir, "conversations")
    n_words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ \n]+"), F.lit(0)))
    k = F.pmod(F.col("conv_id") + F.floor(F.col("turn") / 2), F.lit(3)).cast("int")
    d = c.select(
        F.col("conv_id").alias("meeting_id"), F.col("turn").cast("int").alias("position"), "role", "text", k.alias("k"),
        (400 * n_words).cast("bigint").alias("dur_ms"), (1000 * F.pmod(7 * F.col("conv_id") + 13 * F.col("turn"), F.lit(5))).cast("bigint").alias("gap_ms"),
    )
    before = Window.partitionBy("meeting_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("dur_ms") + F.col("gap_ms")).over(before), F.lit(0)).cast("bigint")
    overlap = F.pmod(3 * F.col("meeting_id") + F.col("position"), F.lit(7)) == 0
    named = F.when(F.col("k") == 0, "Asha").when(F.col("k") == 1, "Ravi").otherwise("Speaker_02")
    return d.withColumn("start_ms", start).select(
        "meeting_id", "position", "start_ms", (F.col("start_ms") + F.col("dur_ms")).alias("end_ms"),
        F.concat(F.lit("Speaker_0"), F.col("k")).alias("speaker_label"),
        F.when(F.pmod(F.col("meeting_id") + F.col("position"), F.lit(11)) == 0, "Asha + Ravi").otherwise(named).alias("speaker"),
        overlap.alias("is_overlap"), F.when(overlap, F.array(F.lit("Asha"), F.lit("Ravi"))).alias("candidate_speakers"),
        F.when(F.col("role") == "user", "en").when(F.col("role") == "assistant", "hi").alias("language"),
        F.concat(F.lit("speaker-"), F.pmod(F.col("meeting_id") + F.col("k"), F.lit(10)) + 1).alias("color"),
        "role", "text",
    )


#: What is said in `sayings`, in every script and with every kind of name, noise and cue that the text rules know.
SAYINGS = [
    "My name is asha, hello all", "good morning Ravi", "Good evening team", "this is o'neil speaking", "cough", "[laughter]", "Thank you!", "मेरा नाम रवि है",
    "मी तुला सांगितले आहे pan nahi", "mi tula kay sangitla", "so, um, well: we should ship it. Then we rest a while", "we decided to go with the plan", "hello Asha",
    "    ", "ক খ hello there", "can you send the report by friday?", "hum kya karte hain", "तुम क्या करते हो", "maybe we go later", "yes, they are",
]


def sayings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript lines of which most say one of SAYINGS, the rest their own text."""
    k = F.pmod(3 * F.col("meeting_id") + F.col("position"), F.lit(len(SAYINGS) + 3)).cast("int")
    said = F.try_element_at(F.array(*[F.lit(x) for x in SAYINGS]), k + 1)
    return lines(spark, sf_dir).withColumn("text", F.when(k < len(SAYINGS), said).otherwise(F.col("text")))


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meetings from `events`."""
    e = table(spark, sf_dir, "events")
    digit = F.pmod(F.col("event_id"), F.lit(10))
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("uploaded_at"), F.col("value").alias("duration_seconds"),
        F.concat(F.lit("Sync "), F.col("user_id")).alias("title"), F.col("props").alias("agenda"),
        F.when(digit == 0, "Processing").when(digit == 1, "Failed").otherwise("Completed").alias("status"),
        F.when(F.col("event_type") == "purchase", "client").when(F.col("event_type") != "error", "internal").alias("meeting_type"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("department"), F.col("user_id").alias("owner_id"),
        F.when(F.pmod(F.col("event_id"), F.lit(17)) == 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("deleted_at"),
    )


def voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voice vectors (vec_id, label, embedding as doubles) from `embeddings`."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def import_json(spark: SparkSession, path: str) -> DataFrame:
    """Meetings of an older JSON store: one object or an array per file; records without an id are skipped."""
    return spark.read.schema(MEETING).json(path, multiLine=True).filter("id IS NOT NULL AND trim(id) <> ''")


def speaker_profiles(raw: DataFrame, name_col: str = "name", json_col: str = "profile") -> DataFrame:
    """Voice profiles in either historical shape: an object with centroid and sample_count, or a bare list (count 1)."""
    shaped = F.from_json(json_col, "struct<centroid: array<float>, sample_count: int>")
    bare = F.from_json(json_col, "array<float>")
    centroid = F.when(F.substring(F.ltrim(json_col), 1, 1) == "[", bare).otherwise(shaped["centroid"])
    return raw.select(F.col(name_col).alias("name"), centroid.alias("centroid"), F.coalesce(F.when(F.substring(F.ltrim(json_col), 1, 1) != "[", shaped["sample_count"]), F.lit(1)).alias("sample_count"))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """The vectors of many meetings (meeting_id, position, start_ms, end_ms, embedding) as a cache, a folder for each meeting."""
    vectors.repartition("meeting_id").sortWithinPartitions("meeting_id", "position").write.partitionBy("meeting_id").parquet(path)


def read_vectors(spark: SparkSession, path: str, meeting=None) -> DataFrame:
    """A cache of vectors, or one meeting's part of it, of which alone the files are read."""
    d = spark.read.parquet(path)
    return d if meeting is None else d.filter(F.col("meeting_id") == meeting)


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """(meeting_id, path, bytes): the first file by name in each meeting's folder under `folder`; contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"))
    owner = F.element_at(F.split("path", "/"), -2)
    return d.groupBy(owner.alias("meeting_id")).agg(F.min("path").alias("path"), F.min_by("bytes", "path").alias("bytes"))


def languages(spark: SparkSession) -> DataFrame:
    """The languages dimension."""
    return spark.createDataFrame(LANGUAGES, "code string, name string")
