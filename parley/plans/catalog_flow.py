"""Registered queries over what flows in: live segments, nested imports, JSON columns, model slots, each beside the DuckDB SQL that checks it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parley.operators import intervals, segments, summaries, turns
from parley.plans.catalog import _ntz, _profiles, _recordings, query
from parley.session import materialise, shared_folder
from parley.sources import duck, model, nested, variants
from parley.streaming import failures

L, VO = duck.LINES, duck.VOICES

# ---------------------------------------------------------------- live segments

PAUSE, LONGEST, FRAME_MS = 3, 60, 200


def _voiced_frames(spark, sf):
    """Frames of 200 ms from 0 to a second after the last line; those inside a line are voiced."""
    lines = model.lines(spark, sf)
    spoken = lines.filter("end_ms > start_ms").select("meeting_id", F.explode(F.sequence(F.floor(F.col("start_ms") / FRAME_MS), F.floor(F.col("end_ms") / FRAME_MS) - 1)).alias("i")).withColumn("voiced", F.lit(True))
    n = lines.groupBy("meeting_id").agg(F.floor(F.max("end_ms") / FRAME_MS).alias("n"))
    # every third meeting stops with its last word, so what is open there is flushed
    stop = F.col("n") + F.when(F.pmod("meeting_id", F.lit(3)) == 0, 0).otherwise(6)
    every = n.filter(stop > 0).select("meeting_id", F.explode(F.sequence(F.lit(0), stop - 1)).alias("i")).withColumn("voiced", F.lit(False))
    # no join: Spark sizes exploded rows as the rows before, and would broadcast them
    return every.unionByName(spoken).groupBy("meeting_id", "i").agg(F.max("voiced").alias("voiced"))


@query(
    f"""WITH RECURSIVE {L}, sp AS (SELECT DISTINCT meeting_id, unnest(range(start_ms // {FRAME_MS}, end_ms // {FRAME_MS})) AS i FROM lines),
nn AS (SELECT meeting_id, max(end_ms) // {FRAME_MS} + CASE WHEN meeting_id % 3 = 0 THEN 0 ELSE 6 END AS n FROM lines GROUP BY meeting_id),
fr AS (SELECT e.meeting_id, e.i, sp.i IS NOT NULL AS v, n FROM (SELECT meeting_id, n, unnest(range(0, n)) AS i FROM nn) e LEFT JOIN sp USING (meeting_id, i)),
walk AS (SELECT meeting_id, -1::BIGINT AS i, false AS talk, 0::BIGINT AS first, 0::BIGINT AS held, NULL::BIGINT AS hush, NULL::VARCHAR AS cause, 0::BIGINT AS s, 0::BIGINT AS e FROM nn
  UNION ALL
  SELECT meeting_id, i, started OR (talk AND NOT ended), CASE WHEN started OR cut THEN i ELSE first END, CASE WHEN started THEN 1 WHEN cut OR ended THEN 0 ELSE h END, CASE WHEN ended THEN NULL ELSE hush END,
    CASE WHEN ended THEN 'pause' WHEN cut THEN 'cut' END, first, i
  FROM (SELECT *, talk AND NOT ended AND h >= {LONGEST} AS cut FROM (SELECT *, talk AND NOT v AND i - hush >= {PAUSE} AS ended, v AND NOT talk AS started FROM (
    SELECT f.meeting_id, f.i, f.v, talk, first, held + talk::INT AS h, CASE WHEN f.v OR NOT talk THEN NULL ELSE coalesce(hush, f.i) END AS hush FROM walk w JOIN fr f ON f.meeting_id = w.meeting_id AND f.i = w.i + 1)))),
fin AS (SELECT meeting_id, arg_max(talk, i) AS talk, arg_max(first, i) AS first, arg_max(held, i) AS held, max(i) + 1 AS n FROM walk GROUP BY 1)
SELECT meeting_id, s AS start, e AS stop, cause FROM walk WHERE cause IS NOT NULL UNION ALL SELECT meeting_id, first, n, 'end' FROM fin WHERE talk AND held > 0"""
)
def speech_segments(spark, sf):
    """Segments with pauses, force cuts and a flush at the end: the batch form of the live stream."""
    return segments.speech_segments(_voiced_frames(spark, sf), "meeting_id", PAUSE, LONGEST)


# ---------------------------------------------------------------- nested records


def _records(spark, sf):
    """Meetings as nested JSON in camel case: lines as transcript, speakers' names as keywords, every fifth without children."""
    line = F.struct(
        "position", (F.col("start_ms") / 1000).alias("start_sec"), (F.col("end_ms") / 1000).alias("end_sec"), "speaker", "speaker_label", "color", "language", "is_overlap", "candidate_speakers", "text"
    )
    xs = model.lines(spark, sf).groupBy("meeting_id").agg(F.array_sort(F.collect_list(line)).alias("xs"), F.array_sort(F.collect_set("speaker")).alias("keywords"))
    whole = F.pmod("meeting_id", F.lit(5)) != 0
    record = F.struct(
        F.concat(F.lit("m-"), F.col("meeting_id").cast("string")).alias("id"), F.concat(F.lit("Sync "), F.col("meeting_id").cast("string")).alias("title"), F.lit("a.wav").alias("fileName"),
        (F.col("meeting_id") * 1000).alias("fileSizeBytes"), F.lit("2024-01-05T10:00:00Z").alias("uploadedAtISO"), F.lit("Completed").alias("status"), F.size("xs").alias("participants"),
        F.when(whole, F.transform("xs", lambda x: x.dropFields("position"))).alias("transcript"), F.when(whole, F.col("keywords")).alias("keywords"),
        F.when(whole, F.transform("keywords", lambda k: F.struct(k.alias("title"), F.lit("Asha").alias("assignee")))).alias("actionItems"), F.lit(1).alias("notInTheSchema"),
    )
    noise = spark.createDataFrame([("{broken",), ('{"title": "no id"}',), ('{"id": " "}',)], "value string")
    return xs.select(F.to_json(record).alias("value")).unionAll(noise)


def _shredded(spark, sf):
    return nested.shred(materialise(nested.parse(_records(spark, sf)), "nested-records"))


@query(f"WITH {L} SELECT 'm-' || meeting_id AS meeting_id, position, start_ms / 1000.0::DOUBLE AS start_sec, end_ms / 1000.0::DOUBLE AS end_sec, speaker, speaker_label, color, language, is_overlap, array_to_string(candidate_speakers, '|') AS candidates, text FROM lines WHERE meeting_id % 5 <> 0")
def imported_transcripts(spark, sf):
    """Children of nested records come back as they went in."""
    d = _shredded(spark, sf)["transcript"]
    return d.select("meeting_id", "position", "start_sec", "end_sec", "speaker", "speaker_label", "color", "language", "is_overlap", F.array_join("candidate_speakers", "|").alias("candidates"), "text")


@query(f"WITH {L} SELECT 'm-' || meeting_id AS id, 'Sync ' || meeting_id AS title, 'a.wav' AS file_name, meeting_id * 1000 AS file_size_bytes, TIMESTAMP '2024-01-05 10:00:00' AS uploaded_at_iso, count(*)::INT AS participants FROM lines GROUP BY meeting_id")
def imported_meetings(spark, sf):
    return _ntz(_shredded(spark, sf)["meetings"].select("id", "title", "file_name", "file_size_bytes", "uploaded_at_iso", "participants"))


@query(
    f"""WITH {L}, k AS (SELECT meeting_id, list_sort(list(DISTINCT speaker)) AS xs FROM lines WHERE meeting_id % 5 <> 0 GROUP BY 1),
e AS (SELECT meeting_id, unnest(range(len(xs))) AS position, unnest(xs) AS value FROM k)
SELECT 'm-' || meeting_id AS meeting_id, 'keywords' AS child, position::INT AS position, value, NULL::VARCHAR AS assignee FROM e UNION ALL SELECT 'm-' || meeting_id, 'action_items', position::INT, value, 'Asha' FROM e"""
)
def imported_children(spark, sf):
    """Lists of scalars and of records, with their positions."""
    t = _shredded(spark, sf)
    words = t["keywords"].select("meeting_id", F.lit("keywords").alias("child"), "position", "value", F.lit(None).cast("string").alias("assignee"))
    return words.unionAll(t["action_items"].select("meeting_id", F.lit("action_items"), "position", F.col("title"), "assignee"))


@query(f"WITH {L}, k AS (SELECT meeting_id, count(*) AS n, count(*) FILTER (position % 4 <> 3) AS m FROM lines WHERE meeting_id % 5 <> 0 GROUP BY 1) SELECT 'm-' || meeting_id AS id, 'transcript' AS child, n AS in_source, m AS in_store FROM k WHERE n <> m")
def import_child_counts(spark, sf):
    """A store that lost every fourth line, against the source, child table by child table."""
    t = _shredded(spark, sf)
    return nested.child_differences(t, t | {"transcript": t["transcript"].filter("position % 4 <> 3")}, ["transcript", "action_items", "keywords"])


@query(f"WITH {L} SELECT 'm-' || meeting_id AS id, CASE WHEN meeting_id % 5 = 0 THEN 0 ELSE count(*) END::INT AS lines, CASE WHEN meeting_id % 5 = 0 THEN 0 ELSE count(DISTINCT speaker) END::INT AS keywords, CASE WHEN meeting_id % 5 <> 0 THEN arg_max(text, position) END AS last_text FROM lines GROUP BY meeting_id")
def exported_records(spark, sf):
    """Tables put together into records again, read back."""
    again = nested.parse(nested.assemble(_shredded(spark, sf))).select("record.*")
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return again.select("id", n("transcript").alias("lines"), n("keywords").alias("keywords"), F.try_element_at("transcript", F.lit(-1))["text"].alias("last_text"))


# ---------------------------------------------------------------- JSON columns as VARIANT


@query(
    f"""WITH {VO}, l AS (SELECT label, count(*)::INT AS n FROM voices GROUP BY 1), p AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(embedding[i]) AS x FROM voices, range(1, 65) t(i) GROUP BY ALL) GROUP BY 1)
SELECT 'voice-' || label AS name, CASE WHEN label % 2 = 0 THEN n ELSE 1 END::INT AS sample_count, 64::INT AS dims, round(list_sum(list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))), 2) AS total FROM l JOIN p USING (label)"""
)
def variant_profiles(spark, sf):
    """Profiles in both historical shapes written and read as VARIANT, with malformed texts and other shapes among them."""
    d = _profiles(spark, sf)
    c, number = F.col("centroid").cast("array<float>"), F.regexp_extract("name", r"(\d+)$", 1).cast("int")
    text = F.when(number % 2 == 0, F.to_json(F.struct(c.alias("centroid"), F.col("samples").alias("sample_count")))).otherwise(F.to_json(c))
    raw = d.select("name", text.alias("text"))
    odd = raw.select("name", F.explode(F.array(*map(F.lit, ["{broken", "[1, 2", '{"centroid": "x"}', '["a", 1]', "7", "null", ""]))).alias("text"))
    path = f"{shared_folder(spark)}/variant-profiles-{uuid.uuid4().hex}"
    raw.unionAll(odd).select("name", variants.decoded(F.col("text")).alias("profile")).write.parquet(path)
    found = variants.profiles(spark.read.parquet(path))
    return found.select("name", "sample_count", F.size("centroid").alias("dims"), F.round(F.aggregate("centroid", F.lit(0.0), lambda t, x: t + x), 2).alias("total"))


@query(f"WITH {L} SELECT meeting_id, position, unnest([0, 1])::INT AS span, unnest(['Asha', 'Ravi']) AS speaker, unnest([text, color]) AS text FROM lines WHERE is_overlap AND position % 2 = 0")
def variant_spans(spark, sf):
    """Attributed spans of overlapping lines through VARIANT; odd lines hold an object instead, which has none."""
    span = lambda who, t: F.struct(F.lit(who).alias("speaker"), F.col(t).alias("text"))
    text = F.when(F.col("position") % 2 == 0, F.to_json(F.array(span("Asha", "text"), span("Ravi", "color")))).otherwise(F.to_json(span("Asha", "text")))
    d = model.lines(spark, sf).filter("is_overlap").select("meeting_id", "position", variants.decoded(text).alias("attributed_spans"))
    return variants.spans(d, ["meeting_id", "position"]).select("meeting_id", "position", "span", "speaker", "text")


@query(
    """WITH p AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN left(props, length(props) - 1) WHEN 1 THEN '[' || props || ', "x"]' ELSE props END AS t FROM events), v AS (SELECT event_id, CASE WHEN json_valid(t) THEN t END AS t FROM p)
SELECT event_id, json_extract_string(t, '$.k') AS k, json_extract_string(t, '$[0].k') AS first, CASE WHEN t IS NOT NULL THEN json_type(t) END AS kind FROM v"""
)
def variant_insights(spark, sf):
    """Fields of JSON documents by path; malformed documents and missing fields are null."""
    k = F.pmod("event_id", F.lit(7))
    text = F.when(k == 0, F.expr("left(props, length(props) - 1)")).when(k == 1, F.concat(F.lit("["), "props", F.lit(', "x"]'))).otherwise(F.col("props"))
    d = model.table(spark, sf, "events").select("event_id", variants.decoded(text).alias("v"))
    kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
    field = lambda path: variants.insight(F.col("v"), path)
    return d.select("event_id", field("$.k").alias("k"), field("$[0].k").alias("first"), F.when(F.col("v").isNotNull(), kind).alias("kind"))


# ---------------------------------------------------------------- a model in the slot


def _first_words(n: int):
    """A stand-in for a model: the first words of a prompt; none for prompts that begin with a question mark."""

    def make():
        import numpy as np

        def predict(prompts):
            return np.array([" ".join(p.split()[:n]) if p and not p.startswith("?") else "" for p in prompts], object)

        return predict

    return make


WALK = duck.LINES.replace("w AS (", "RECURSIVE w AS (", 1) + """,
win AS (SELECT meeting_id, position, start_ms, 0 AS n, start_ms AS began FROM lines WHERE position = 0
  UNION ALL SELECT l.meeting_id, l.position, l.start_ms, CASE WHEN l.start_ms - began >= 20000 THEN n + 1 ELSE n END, CASE WHEN l.start_ms - began >= 20000 THEN l.start_ms ELSE began END FROM win JOIN lines l ON l.meeting_id = win.meeting_id AND l.position = win.position + 1)"""


@query(
    f"""WITH {WALK}, c AS (SELECT meeting_id, n, CASE WHEN (meeting_id + n) % 4 = 0 THEN '?' ELSE '' END || string_agg(text, ' ' ORDER BY position) AS content FROM win JOIN lines USING (meeting_id, position) GROUP BY 1, 2),
p AS (SELECT meeting_id, n, array_to_string(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')[1:6], ' ') AS part FROM c WHERE NOT starts_with(content, '?')),
g AS (SELECT meeting_id, list(part ORDER BY n) AS xs FROM p WHERE part <> '' GROUP BY 1), m AS (SELECT DISTINCT meeting_id FROM lines)
SELECT m.meeting_id, CASE WHEN len(xs) > 1 THEN array_to_string(list_filter(regexp_split_to_array(array_to_string(xs, ' '), '\\s+'), lambda x: x <> '')[1:8], ' ') ELSE xs[1] END AS summary, coalesce(len(xs), 0)::INT AS parts FROM m LEFT JOIN g USING (meeting_id)"""
)
def summary_map_reduce(spark, sf):
    """Windows of 20 s through a stand-in model, and its parts through another; a quarter of the windows have no answer."""
    d = turns.summary_windows(model.lines(spark, sf), width_ms=20_000).groupBy("meeting_id", "summary_window").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("xs"))
    mute = F.when(F.pmod(F.col("meeting_id") + F.col("summary_window"), F.lit(4)) == 0, "?").otherwise("")
    d = d.select("meeting_id", "summary_window", F.concat(mute, F.array_join(F.transform("xs", lambda x: x["text"]), " ")).alias("content"))
    return summaries.map_reduce(d, _first_words(6), _first_words(8))


# ---------------------------------------------------------------- windows over samples, rows that fail


@query(
    f"""WITH {VO}, r AS (SELECT vec_id, embedding AS x FROM voices), st AS (SELECT vec_id, x, unnest(range(0, 64 - 19 + 1, 8)) AS s FROM r),
f AS (SELECT vec_id, s, [x[s + k] FOR k IN range(1, 20)] AS v FROM st), g AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s) AS n FROM f)
SELECT a.vec_id, (a.n - 1)::INT AS i, b.s::INT AS start, round(1 - list_cosine_similarity(a.v, b.v), 6) AS distance FROM g a JOIN g b ON a.vec_id = b.vec_id AND b.n = a.n + 1"""
)
def hopping_distances(spark, sf):
    """Windows of 0.6 s every 0.25 s over two seconds of 32 samples each, and how far each is from the one before."""
    width, hop = int(0.6 * 32), int(0.25 * 32)
    d = intervals.window_distances(model.voices(spark, sf), ["vec_id"], "embedding", lambda x: x, width, hop)
    return d.withColumn("distance", F.round("distance", 6))


def _norm_of(v):
    """The length of a vector of 64 numbers; anything else is an error."""
    import math

    if v is None:
        raise ValueError("no vector")
    if len(v) != 64:
        raise ValueError("wrong length")
    if any(x != x for x in v):
        raise ValueError("not a number")
    return math.sqrt(math.fsum(x * x for x in v))


@query(
    f"""WITH {VO}, b AS (SELECT vec_id, vec_id % 10 AS k, sqrt(list_sum(list_transform(embedding, lambda x: x * x))) AS n FROM voices)
SELECT vec_id, CASE WHEN k > 2 THEN round(n, 6) END AS norm, CASE k WHEN 0 THEN 'ValueError: no vector' WHEN 1 THEN 'ValueError: wrong length' WHEN 2 THEN 'ValueError: not a number' END AS error FROM b"""
)
def failed_rows(spark, sf):
    """Three kinds of bad vectors among good ones, each row with its value or its error."""
    k = F.pmod("vec_id", F.lit(10))
    bad = F.when(k == 0, F.lit(None)).when(k == 1, F.slice("embedding", F.lit(1), F.lit(3))).when(k == 2, F.transform("embedding", lambda x: F.lit(float("nan")))).otherwise(F.col("embedding"))
    d = _recordings(spark, sf).select("vec_id", bad.alias("embedding"))
    return failures.with_errors(d, _norm_of, ["embedding"], "double", "norm").select("vec_id", F.round("norm", 6).alias("norm"), "error")
