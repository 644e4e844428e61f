"""Registered queries over the store, dashboards, talk time, names and intervals, each beside the DuckDB SQL that checks it."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.functions import vocabulary as V
from parley.operators import dashboard as D
from parley.operators import insights, intervals, names, search, store, turns
from parley.operators import talk_time as talk
from parley.operators.search_index import SearchIndex
from parley.plans.catalog import AS_OF, SHARES, _ntz, _shares, _tasks, query
from parley.plans.catalog_text import DEVA, said
from parley.session import shared_folder
from parley.sources import duck, model

L, M, SAID = duck.LINES, duck.MEETINGS, duck.SAID


# ---------------------------------------------------------------- dashboard


def _range(test: str) -> str:
    return f"WITH {M} SELECT id FROM meetings WHERE uploaded_at IS NULL OR {test}"


@query(_range(f"epoch(TIMESTAMP '{AS_OF}') - epoch(uploaded_at) <= 30 * 86400"))
def range_30d(spark, sf):
    return D.in_range(model.meetings(spark, sf), "30d", AS_OF).select("id")


@query(_range(f"date_trunc('month', uploaded_at) = date_trunc('month', TIMESTAMP '{AS_OF}')"))
def range_month(spark, sf):
    return D.in_range(model.meetings(spark, sf), "month", AS_OF).select("id")


@query(_range("uploaded_at::DATE = DATE '2024-01-17'"))
def range_day(spark, sf):
    return D.in_range(model.meetings(spark, sf), "day", AS_OF, "2024-01-17").select("id")


@query(f"WITH {M} SELECT id FROM meetings WHERE deleted_at IS NULL AND status = 'Failed' ORDER BY uploaded_at DESC, id DESC LIMIT 3")
def recent_failed(spark, sf):
    return D.newest(model.meetings(spark, sf).filter("status = 'Failed'"), 3).select("id")


@query(
    f"""WITH {M}, u AS (SELECT id, CASE WHEN id % 6 <> 0 THEN uploaded_at END AS upl FROM meetings), s AS (SELECT unnest(generate_series(DATE '{AS_OF[:10]}' - 6, DATE '{AS_OF[:10]}', INTERVAL 1 DAY))::DATE AS day),
c AS (SELECT s.day, count(id) AS n FROM s LEFT JOIN u ON coalesce(upl::DATE, DATE '{AS_OF[:10]}') = s.day GROUP BY 1)
SELECT day::VARCHAR AS day, n, day = DATE '{AS_OF[:10]}' AS is_today, CASE WHEN n > 0 THEN greatest(round(100.0::DOUBLE * n / max(n) OVER (), 1), 14) ELSE 0 END::DOUBLE AS bar FROM c"""
)
def daily_uploads_undated(spark, sf):
    """Uploads without a date count as today's."""
    m = model.meetings(spark, sf).withColumn("uploaded_at", F.when(F.pmod("id", F.lit(6)) != 0, F.col("uploaded_at")))
    return D.daily_uploads(m, AS_OF, missing_is_today=True).withColumn("day", F.col("day").cast("string"))


FLAT = f"""{M}, a AS (SELECT id, 'Review ' || department AS t, CASE WHEN owner_id % 2 = 0 THEN 'Asha' ELSE 'Unassigned' END AS who FROM meetings),
tasks AS (SELECT id, t AS title, who AS assignee FROM a WHERE t IS NOT NULL UNION ALL SELECT id, CASE WHEN id % 3 = 0 THEN coalesce(t, 'Plan') ELSE 'Call back' END, 'Ravi' FROM a WHERE id % 3 <> 0 OR t IS NULL)"""


@query(f"WITH {FLAT} SELECT id, count(*) AS tasks, count(*) FILTER (assignee <> 'Unassigned') AS assigned FROM tasks GROUP BY id")
def task_totals(spark, sf):
    return D.task_totals(D.flatten_tasks(_tasks(spark, sf)))


@query(f"WITH {FLAT} SELECT id, title FROM meetings WHERE id IN (SELECT id FROM tasks WHERE assignee = 'Asha') OR NOT EXISTS (SELECT 1 FROM tasks WHERE assignee = 'Asha')")
def task_list(spark, sf):
    return D.task_list(model.meetings(spark, sf), D.flatten_tasks(_tasks(spark, sf)).filter("assignee = 'Asha'")).select("id", "title")


@query(f"WITH {M} SELECT id, title FROM meetings")
def task_list_without_tasks(spark, sf):
    return D.task_list(model.meetings(spark, sf), D.flatten_tasks(_tasks(spark, sf)).filter("assignee = 'Nobody'")).select("id", "title")


# ---------------------------------------------------------------- store


@query(f"WITH {M} SELECT id, title, agenda, status FROM meetings UNION ALL SELECT id + 1000000, 'New ' || title, NULL, 'Processing' FROM meetings WHERE status = 'Failed'")
def insert_meetings(spark, sf):
    m = model.meetings(spark, sf).select("id", "title", "agenda", "status")
    new = m.filter("status = 'Failed'").select((F.col("id") + 1_000_000).alias("id"), F.concat(F.lit("New "), "title").alias("title"), F.lit("Processing").alias("status"))
    return store.insert(m, new)


@query(f"WITH {L} SELECT meeting_id, position, speaker FROM lines WHERE meeting_id NOT IN (SELECT meeting_id FROM lines WHERE speaker = 'Asha + Ravi') UNION ALL SELECT meeting_id, 0, 'only' FROM lines WHERE speaker = 'Asha + Ravi'")
def replace_children(spark, sf):
    lines = model.lines(spark, sf).select("meeting_id", "position", "speaker")
    return store.replace_children(lines, lines.filter("speaker = 'Asha + Ravi'").select("meeting_id", F.lit(0).alias("position"), F.lit("only").alias("speaker")))


WORDS = "kw AS (SELECT meeting_id, position, unnest(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' ')) AS word FROM lines), wc AS (SELECT meeting_id, word, count(*)::BIGINT AS count, position FROM kw WHERE word <> '' GROUP BY 1, 2, 4)"


@query(f"WITH {L}, {WORDS}, sm AS (SELECT meeting_id, word, sum(count)::BIGINT AS count, min(position * 100000 + ascii(word)) AS first FROM wc GROUP BY 1, 2) SELECT meeting_id, word, count FROM sm")
def keyword_dedup(spark, sf):
    w = F.explode(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " ")).alias("word")
    rows = model.lines(spark, sf).select("meeting_id", "position", w).filter("word <> ''").groupBy("meeting_id", "word", "position").agg(F.count("*").alias("count"))
    return store.dedup_keywords(rows).select("meeting_id", "word", "count")


@query(f"WITH {L} SELECT meeting_id, position, CASE WHEN speaker = 'Ravi' OR speaker_label = 'Ravi' THEN 'R. Rao' END AS identified_as, CASE WHEN speaker = 'Ravi' OR speaker_label = 'Ravi' THEN 0.9 END::DOUBLE AS confidence FROM lines")
def set_identification(spark, sf):
    return store.set_identification(model.lines(spark, sf), "Ravi", "R. Rao", 0.9).select("meeting_id", "position", "identified_as", "confidence")


@query(f"WITH {SHARES}, rn AS (SELECT meeting_id, CASE WHEN name = 'Speaker_02' THEN 'Asha' ELSE name END AS name, ms, rank FROM shares), gr AS (SELECT meeting_id, name, sum(ms) AS ms, min(rank) AS first FROM rn GROUP BY 1, 2) SELECT meeting_id, name, round(ms, 3) AS ms, round(100 * ms / sum(ms) OVER (PARTITION BY meeting_id), 1) AS pct, (row_number() OVER (PARTITION BY meeting_id ORDER BY first) - 1)::INT AS position FROM gr")
def merged_stats(spark, sf):
    """Stored stats after one speaker is renamed to another."""
    s = _shares(spark, sf).withColumn("name", F.when(F.col("name") == "Speaker_02", "Asha").otherwise(F.col("name"))).withColumnRenamed("rank", "position").drop("pct")
    return store.merge_stats(s).withColumn("ms", F.round("ms", 3))


@query(f"WITH {L}, dl AS (SELECT * FROM lines WHERE lower(speaker) <> 'ravi'), t AS (SELECT meeting_id, speaker AS name, sum(greatest(end_ms - start_ms, 0))::BIGINT AS ms, min(position) AS first FROM dl GROUP BY 1, 2) SELECT meeting_id, name, ms, (row_number() OVER (PARTITION BY meeting_id ORDER BY first) - 1)::INT AS position FROM t")
def stats_after_deletion(spark, sf):
    """A speaker deleted and the stored stats rebuilt."""
    return talk.plain_shares(store.delete_speaker(model.lines(spark, sf), "ravi")).select("meeting_id", "name", "ms", "position")


@query()
def session_dumps(spark, sf):
    lines = model.lines(spark, sf)
    d = store.session_dump(lines, _shares(spark, sf), talk.language_breakdown(lines))
    return d.select("meeting_id", F.size("transcript").alias("lines"), F.size("raw_segments").alias("segments"), F.size("stats").alias("people"), F.size("languages").alias("languages"), F.round(F.element_at(F.map_values("times"), 1), 3).alias("first_ms"))


@query(f"WITH {M}, {L} SELECT id, title, CASE WHEN id = 3 THEN 'Processing' ELSE status END AS status, CASE WHEN id <> 3 THEN duration_seconds END AS duration_seconds, CASE WHEN id = 3 THEN TIMESTAMP '{AS_OF}' ELSE uploaded_at END AS uploaded_at, (SELECT count(*) FROM lines WHERE meeting_id <> 3) AS lines_left FROM meetings")
def reset_for_upload(spark, sf):
    m, (lines,) = store.reset_for_upload(model.meetings(spark, sf), 3, AS_OF, [model.lines(spark, sf)])
    left = lines.agg(F.count("*").alias("lines_left"))  # one row
    return _ntz(m.select("id", "title", "status", "duration_seconds", "uploaded_at").crossJoin(F.broadcast(left)))


@query(f"WITH {M}, {L} SELECT id FROM meetings WHERE status = 'Completed' AND id IN (SELECT meeting_id FROM lines) AND id % 4 <> 0")
def to_summarise(spark, sf):
    m = model.meetings(spark, sf).withColumn("summary", F.when(F.pmod("id", F.lit(4)) == 0, "done").when(F.pmod("id", F.lit(4)) == 1, " "))
    return store.to_summarise(m, model.lines(spark, sf)).select("id")


@query(f"WITH {M} SELECT id, title FROM meetings WHERE id % 3 = 0 AND id % 5 <> 0 UNION ALL SELECT id, 'imported' FROM meetings WHERE id % 5 = 0")
def import_replace(spark, sf):
    m = model.meetings(spark, sf).select("id", "title")
    return store.reconcile(m.filter("id % 5 = 0").withColumn("title", F.lit("imported")), m.filter("id % 3 = 0"), replace=True)


@query(f"WITH {L}, r AS (SELECT meeting_id, position, text, CASE WHEN position % 2 = 0 THEN 'raw ' || text END AS raw FROM lines) SELECT meeting_id, position, coalesce(raw, text) AS raw_text, text AS cleaned_text FROM r")
def backfilled_texts(spark, sf):
    raw = F.when(F.pmod("position", F.lit(2)) == 0, F.concat(F.lit("raw "), "text"))
    d = model.lines(spark, sf).withColumns({"raw_text": raw, "cleaned_text": F.lit(None).cast("string")})
    return store.backfill_texts(d).select("meeting_id", "position", "raw_text", "cleaned_text")


@query(f"WITH {M}, a AS (SELECT id, title, status, id % 7 <> 0 AS here FROM meetings), b AS (SELECT id, CASE WHEN id % 100 = 0 THEN 'other' ELSE title END AS title, status, id % 11 <> 0 AS here FROM meetings) SELECT a.id, CASE WHEN a.here AND b.here THEN 'title' ELSE 'title,status' END AS differs, a.here AS in_source, b.here AS in_store FROM a JOIN b USING (id) WHERE (a.here OR b.here) AND NOT (a.here AND b.here AND a.title = b.title)")
def import_differences(spark, sf):
    """Rows that only one side has, and rows whose fields differ."""
    m = model.meetings(spark, sf)
    other = m.withColumn("title", F.when(F.col("id") % 100 == 0, "other").otherwise(F.col("title"))).filter("id % 11 <> 0")
    return store.verify_import(m.filter("id % 7 <> 0"), other, ["title", "status"]).withColumn("differs", F.array_join("differs", ","))


# ---------------------------------------------------------------- talk time and turns

STATS = f"""{L}, st AS (SELECT meeting_id, speaker AS name, sum(end_ms - start_ms)::BIGINT AS ms, min(position) AS position FROM lines GROUP BY 1, 2), mx AS (SELECT *, max(contains(name, '+')) OVER (PARTITION BY meeting_id) AS mixed FROM st)"""


def _split(which: str) -> str:
    return f"sp AS (SELECT meeting_id, position, ms / len(string_split(name, ' + ')) AS ms, unnest(string_split(name, ' + ')) AS name FROM mx WHERE {which}), g AS (SELECT meeting_id, name, sum(ms) AS ms, min(position) AS position FROM sp GROUP BY 1, 2 HAVING sum(ms) > 0)"


@query(f"WITH {STATS}, {_split('mixed')} SELECT meeting_id, name, round(ms, 3) AS ms FROM g UNION ALL SELECT meeting_id, name, ms::DOUBLE FROM mx WHERE NOT mixed")
def stats_cleaned(spark, sf):
    return talk.clean_stats(_stored(spark, sf)).select("meeting_id", "name", F.round("ms", 3).alias("ms"))


def _stored(spark, sf):
    return model.lines(spark, sf).groupBy("meeting_id", F.col("speaker").alias("name")).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"), F.min("position").alias("position"))


@query(f"WITH {STATS}, {_split('true')} SELECT meeting_id, name, round(ms, 3) AS ms, (row_number() OVER (PARTITION BY meeting_id ORDER BY ms DESC, position) - 1)::INT AS position FROM g")
def stats_cleaned_always(spark, sf):
    return talk.clean_stats(_stored(spark, sf), always=True).select("meeting_id", "name", F.round("ms", 3).alias("ms"), "position")


@query(f"WITH {SAID} SELECT meeting_id, count(*) FILTER (regexp_matches(text, '[\\x{{0980}}-\\x{{0D7F}}]')) AS leaks FROM said GROUP BY 1")
def script_leaks(spark, sf):
    return talk.script_leaks(said(spark, sf))


@query(f"WITH {L} SELECT meeting_id, count(*) FILTER (is_overlap) AS overlap, count(*) FILTER (is_overlap AND len(coalesce(candidate_speakers, [])) > 1) AS with_candidates FROM lines GROUP BY 1")
def overlap_sweep(spark, sf):
    return talk.overlap_sweep(model.lines(spark, sf))


@query(f"WITH {L} SELECT meeting_id, speaker_label, sum(greatest(end_ms - start_ms, 0))::BIGINT AS ms FROM lines GROUP BY 1, 2")
def label_totals(spark, sf):
    return talk.label_totals(model.lines(spark, sf))


@query(
    f"""WITH {SAID}, b AS (SELECT meeting_id, language AS code, text, (end_ms - start_ms) AS dur, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS lat, length(regexp_replace(text, '[^{DEVA}]', '', 'g')) AS dev FROM said WHERE language IS NOT NULL AND end_ms > start_ms),
p AS (SELECT meeting_id, code, dur::DOUBLE AS ms FROM b WHERE NOT (lat > 0 AND dev > 0) UNION ALL SELECT meeting_id, 'en', dur * lat / (lat + dev) FROM b WHERE lat > 0 AND dev > 0 UNION ALL SELECT meeting_id, CASE WHEN code IN ('hi', 'mr') THEN code ELSE 'mr' END, dur * dev / (lat + dev) FROM b WHERE lat > 0 AND dev > 0),
g AS (SELECT meeting_id, code, sum(ms) AS ms FROM p GROUP BY 1, 2), sh AS (SELECT *, round(100 * ms / sum(ms) OVER (PARTITION BY meeting_id), 1) AS pct FROM g) SELECT meeting_id, code, round(ms, 3) AS ms, pct FROM sh WHERE ms > 50"""
)
def language_breakdown_by_script(spark, sf):
    """Lines in both scripts split between English and their Indic language."""
    return talk.language_breakdown(said(spark, sf)).withColumn("ms", F.round("ms", 3))


NOISE = f"regexp_matches(trim(text), '(?i)^\\s*\\(?\\[?\\s*({'|'.join(V.SOUNDS)})\\.?\\s*\\]?\\)?\\s*$')"
#: Sayings, and of every other meeting the first two lines alone, the second or the first of which is often a noise.
def _noisy(spark, sf):
    d = said(spark, sf)
    short, at = F.pmod("meeting_id", F.lit(2)) == 0, F.pmod("meeting_id", F.lit(6))
    sound = (short & ((at == 0) & (F.col("position") == 0) | (at == 2) & (F.col("position") == 1) | (at == 4)))
    return d.filter(~short | (F.col("position") < 2)).withColumn("text", F.when(sound, "[cough]").otherwise(F.col("text")))


NOISY = f"""{SAID}, ny AS (SELECT * REPLACE (CASE WHEN meeting_id % 2 = 0 AND (meeting_id % 6 = position * 2 OR meeting_id % 6 = 4) THEN '[cough]' ELSE text END AS text) FROM said WHERE meeting_id % 2 <> 0 OR position < 2),
nz AS (SELECT *, {NOISE} AS noise FROM ny)"""
SMOOTH = f"""{NOISY}, bf AS (SELECT *, last_value(CASE WHEN NOT noise THEN speaker_label END IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(speaker_label) OVER (PARTITION BY meeting_id ORDER BY position ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS nxt, row_number() OVER (PARTITION BY meeting_id ORDER BY position) AS rn, count(*) OVER (PARTITION BY meeting_id) AS total FROM nz),
ld AS (SELECT *, first_value(CASE WHEN rn = 1 AND noise THEN nxt END IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY position) AS lead FROM bf),
mr AS (SELECT *, CASE WHEN noise THEN coalesce(before, lead, speaker_label) ELSE speaker_label END AS label FROM ld WHERE total <> 2),
pr AS (SELECT a.meeting_id, a AS x, b AS y FROM ld a JOIN ld b ON a.meeting_id = b.meeting_id AND a.rn = 1 AND b.rn = 2 WHERE a.total = 2),
sm AS (SELECT meeting_id, position, speaker_label, label, CASE WHEN label <> speaker_label THEN label ELSE speaker END AS display FROM mr
  UNION ALL SELECT meeting_id, y.position, y.speaker_label, CASE WHEN y.noise THEN x.speaker_label ELSE y.speaker_label END, CASE WHEN y.noise THEN x.speaker ELSE y.speaker END FROM pr
  UNION ALL SELECT meeting_id, x.position, x.speaker_label, CASE WHEN x.noise AND NOT y.noise THEN y.speaker_label ELSE x.speaker_label END, CASE WHEN x.noise AND NOT y.noise THEN y.speaker ELSE x.speaker END FROM pr)"""


@query(f"WITH {SMOOTH} SELECT meeting_id, position, label AS speaker_label, display AS speaker FROM sm")
def smoothed_labels(spark, sf):
    return turns.smooth_noise(_noisy(spark, sf)).select("meeting_id", "position", "speaker_label", "speaker")


@query(f"WITH {SMOOTH} SELECT meeting_id, count(*) FILTER (label IS DISTINCT FROM speaker_label) AS changed FROM sm GROUP BY 1")
def smoothing_changes(spark, sf):
    d = _noisy(spark, sf)
    return turns.change_count(d, turns.smooth_noise(d))


@query(f"WITH {L}, p AS (SELECT meeting_id, position, string_split(speaker, ' + ') AS people, list_filter(list_transform(string_split(regexp_replace(text, '([.!?,;।])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(10))), lambda s: s <> '') AS cs FROM lines WHERE contains(speaker, '+')), u AS (SELECT meeting_id, position, people, unnest(cs) AS clause, unnest(range(len(cs))) AS n FROM p) SELECT meeting_id, position, n::INT AS clause_no, people[(n % 2 + 1)::INT] AS speaker FROM u")
def clause_speakers(spark, sf):
    return turns.clauses(model.lines(spark, sf)).select("meeting_id", "position", "clause_no", "speaker")


# ---------------------------------------------------------------- names


HAILS = ["hello Ravi", "good morning Asha, shall we start", "hi Priya"]
HAILED = f"""{L}, h AS (SELECT meeting_id, position, 'Speaker_0' || ((meeting_id + position) % 3) AS speaker_label, speaker, start_ms, end_ms,
  CASE (meeting_id + position * position) % 4 WHEN 0 THEN 'Ravi' WHEN 1 THEN 'Asha' WHEN 2 THEN 'Priya' END AS greeted FROM lines)"""


def _hailed(spark, sf):
    """Lines of three labels in turn that greet one of three people, or nobody."""
    k = F.pmod(F.col("meeting_id") + F.col("position") * F.col("position"), F.lit(4)).cast("int")
    label = F.concat(F.lit("Speaker_0"), F.pmod(F.col("meeting_id") + F.col("position"), F.lit(3)))
    return model.lines(spark, sf).withColumns({"text": F.get(F.array(*[F.lit(x) for x in HAILS]), k), "speaker_label": label})


@query(
    f"""WITH RECURSIVE {HAILED}, f AS (SELECT meeting_id, right(speaker_label, 1)::INT + 1 AS l, min(position) AS at, arg_min(greeted, position) AS g FROM h WHERE greeted IS NOT NULL GROUP BY 1, 2),
p AS (SELECT a.meeting_id, a.l AS la, b.l AS lb, b.g AS na, a.g AS nb, row_number() OVER (PARTITION BY a.meeting_id ORDER BY a.at, b.at) AS r FROM f a JOIN f b ON a.meeting_id = b.meeting_id AND a.at < b.at AND a.g <> b.g),
walk AS (SELECT DISTINCT meeting_id, 0::BIGINT AS r, [NULL, NULL, NULL]::VARCHAR[] AS n FROM f
  UNION ALL SELECT w.meeting_id, p.r, list_transform([1, 2, 3], lambda i: CASE WHEN i = la AND (n[la] IS NULL AND (n[lb] IS NULL OR n[lb] = nb)) THEN na WHEN i = lb AND (n[lb] IS NULL AND (n[la] IS NULL OR n[la] = na)) THEN nb ELSE n[i] END)
  FROM walk w JOIN p ON p.meeting_id = w.meeting_id AND p.r = w.r + 1),
fin AS (SELECT meeting_id, arg_max(n, r) AS n FROM walk GROUP BY 1), each AS (SELECT meeting_id, unnest([0, 1, 2]) AS l, unnest(n) AS name FROM fin)
SELECT meeting_id, 'Speaker_0' || l AS speaker_label, name FROM each WHERE name IS NOT NULL"""
)
def mutual_greetings(spark, sf):
    return names.mutual_greetings(_hailed(spark, sf))


@query()
def greeting_repairs(spark, sf):
    return names.greeting_repairs(said(spark, sf))


@query()
def repaired_lines(spark, sf):
    return names.repair(said(spark, sf)).select("meeting_id", "position", "speaker")


ADDRESSED = "nullif(lower(regexp_extract(coalesce(text, ''), '(?i)(?:good\\s+(?:morning|afternoon|evening)|hello|hi|namaste)\\s+([A-Za-z][A-Za-z''-]+)', 1)), '')"


def _answered(spark, sf):
    """Lines of known people close in time, of which some greet a speaker of the meeting, some a stranger."""
    k = F.pmod(F.col("meeting_id") + F.col("position"), F.lit(5))
    text = F.when(k == 0, "hello ravi").when((k == 2) & (F.pmod("meeting_id", F.lit(3)) == 0), "hi Asha and all").when((k == 3) & (F.pmod("meeting_id", F.lit(7)) == 0), "Namaste Meera").otherwise("this is fine")
    speaker = F.when(F.pmod(F.col("meeting_id") + F.col("position"), F.lit(11)) == 0, "Ravi").when(F.col("speaker").contains("Speaker") & (F.pmod("meeting_id", F.lit(8)) != 0), "Ravi").otherwise(F.col("speaker"))
    return model.lines(spark, sf).withColumns({"text": text, "speaker": speaker, "start_ms": F.floor(F.col("start_ms") / 2), "end_ms": F.floor(F.col("end_ms") / 2)})


@query(
    f"""WITH {L}, a AS (SELECT meeting_id, position, start_ms // 2 AS s, end_ms // 2 AS e, speaker_label,
  CASE WHEN (meeting_id + position) % 11 = 0 OR (contains(speaker, 'Speaker') AND meeting_id % 8 <> 0) THEN 'Ravi' ELSE speaker END AS speaker,
  CASE WHEN (meeting_id + position) % 5 = 0 THEN 'hello ravi' WHEN (meeting_id + position) % 5 = 2 AND meeting_id % 3 = 0 THEN 'hi Asha and all' WHEN (meeting_id + position) % 5 = 3 AND meeting_id % 7 = 0 THEN 'Namaste Meera' ELSE 'this is fine' END AS text FROM lines),
g AS (SELECT *, {ADDRESSED} AS greeted FROM a),
own AS (SELECT DISTINCT g.meeting_id FROM g JOIN a ON a.meeting_id = g.meeting_id AND (a.s, a.position) > (g.s, g.position) AND a.s - g.e <= 20000
  AND (a.speaker_label = g.speaker_label OR lower(a.speaker) = lower(g.speaker)) AND lower(a.speaker) <> g.greeted WHERE g.greeted IS NOT NULL),
ab AS (SELECT DISTINCT meeting_id FROM g WHERE greeted IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE a.meeting_id = g.meeting_id AND lower(a.speaker) = g.greeted))
SELECT meeting_id, bool_or(regexp_matches(speaker, '(?i)^speaker[_ ]?[0-9]+$')) OR meeting_id IN (SELECT meeting_id FROM own) OR meeting_id IN (SELECT meeting_id FROM ab) AS needs_repair FROM a GROUP BY meeting_id"""
)
def meetings_to_repair(spark, sf):
    return names.needs_repair(_answered(spark, sf))


@query(f"WITH {duck.VOICES} SELECT DISTINCT 'voice-' || label AS name FROM voices WHERE 'voice-' || label <> 'voice-3'")
def rename_suggestions(spark, sf):
    return names.rename_suggestions(model.voices(spark, sf).select(F.concat(F.lit("voice-"), "label").alias("name")), "VOICE-3")


@query(f"WITH {duck.VOICES} SELECT DISTINCT 'voice-' || label AS name FROM voices")
def enrolled_names(spark, sf):
    return names.enrolled_names(model.voices(spark, sf).select(F.concat(F.lit("voice-"), "label").alias("name")))


CLAIMS = f"{L}, cl AS (SELECT meeting_id, speaker_label, 0 AS source, 'first ' || min(speaker) AS name FROM lines WHERE position % 3 = 0 GROUP BY 1, 2 UNION ALL SELECT meeting_id, speaker_label, 1, 'second ' || min(speaker) FROM lines GROUP BY 1, 2), won AS (SELECT meeting_id, speaker_label, arg_min(name, source) AS name, min(source)::INT AS source FROM cl GROUP BY 1, 2)"


def _claims(spark, sf):
    lines = model.lines(spark, sf)
    claim = lambda d, tag: d.groupBy("meeting_id", "speaker_label").agg(F.concat(F.lit(tag), F.min("speaker")).alias("name"))
    return names.first_claims(claim(lines.filter("position % 3 = 0"), "first "), claim(lines, "second "))


@query(f"WITH {CLAIMS} SELECT * FROM won")
def first_claims(spark, sf):
    return _claims(spark, sf)


@query(f"WITH {CLAIMS} SELECT l.meeting_id, position, CASE WHEN regexp_matches(speaker, '(?i)^speaker[_ ]?[0-9]+$') THEN coalesce(name, speaker_label) ELSE speaker END AS speaker FROM lines l LEFT JOIN won USING (meeting_id, speaker_label)")
def resolved_names(spark, sf):
    return names.resolve(model.lines(spark, sf), _claims(spark, sf).drop("source")).select("meeting_id", "position", "speaker")


@query(f"WITH {L} SELECT meeting_id, position, CASE speaker WHEN 'Asha + Ravi' THEN 'ASHA R + Ravi' WHEN 'Asha' THEN 'ASHA R' WHEN 'Speaker_02' THEN 'Third' ELSE speaker END AS display, array_to_string(CASE WHEN is_overlap THEN ['ASHA R', 'Ravi'] WHEN speaker = 'Asha + Ravi' THEN ['ASHA R', 'Ravi'] WHEN speaker = 'Asha' THEN ['ASHA R'] WHEN speaker = 'Speaker_02' THEN ['Third'] ELSE [speaker] END, '|') AS speakers FROM lines")
def display_speakers(spark, sf):
    """Shown names from the stats: a label, another spelling of a name, and both inside composites; each once."""
    lines = model.lines(spark, sf).withColumn("candidate_speakers", F.when(F.col("is_overlap"), F.array(F.lit("asha"), F.lit("Ravi"), F.lit("ASHA"))))
    lines = lines.withColumn("speaker", F.regexp_replace("speaker", "Asha", "asha"))
    one = F.explode(F.array(F.struct(F.lit("Speaker_02").alias("label"), F.lit("Third").alias("name"), F.lit(1).alias("position")), F.struct(F.lit("asha").alias("label"), F.lit("ASHA R").alias("name"), F.lit(0).alias("position"))))
    stats = lines.select("meeting_id").distinct().select("meeting_id", one.alias("s")).select("meeting_id", "s.*")
    return names.with_display_names(lines, stats).select("meeting_id", "position", "display", F.array_join("speakers", "|").alias("speakers"))


@query(f"WITH {L} SELECT meeting_id, position, CASE WHEN position % 4 = 0 THEN speaker_label ELSE speaker END AS speaker, CASE WHEN position % 3 = 0 THEN '#3b82f6' ELSE color END AS color FROM lines WHERE position % 5 <> 4")
def valid_segments(spark, sf):
    p = lambda n: F.pmod("position", F.lit(n))
    d = model.lines(spark, sf).withColumns({"speaker": F.when(p(5) == 4, F.lit(None)).when(p(4) == 0, "").otherwise(F.col("speaker")), "speaker_label": F.when(p(5) == 4, "").otherwise(F.col("speaker_label")), "color": F.when(p(3) == 0, F.lit(None)).otherwise(F.col("color"))})
    return names.valid_segments(d).select("meeting_id", "position", "speaker", "color")


@query(f"WITH {M}, m AS (SELECT department AS team, owner_id AS id, min(title) AS name FROM meetings WHERE department IS NOT NULL GROUP BY 1, 2), b AS (SELECT team, id, name, 1 AS mine FROM m WHERE id <> 7 UNION ALL SELECT team, 7, 'Me', 0 FROM m GROUP BY 1) SELECT team, id, name, (row_number() OVER (PARTITION BY team ORDER BY mine, id) - 1)::INT AS position FROM b")
def rosters(spark, sf):
    m = model.meetings(spark, sf).filter("department IS NOT NULL").groupBy(F.col("department").alias("team"), F.col("owner_id").alias("id")).agg(F.min("title").alias("name"))
    own = m.select("team").distinct().select("team", F.lit(7).cast(m.schema["id"].dataType).alias("id"), F.lit("Me").alias("name"))
    return names.roster(m.withColumn("position", F.col("id").cast("int")), own).select("team", "id", "name", "position")


# ---------------------------------------------------------------- intervals

GRID = f"{L}, grid AS (SELECT meeting_id, win, win * 10000 AS w_start, (win + 1) * 10000 - 3000 AS w_end FROM (SELECT meeting_id, unnest(range(0, max(end_ms) // 10000 + 1)) AS win FROM lines GROUP BY 1))"


@query(f"WITH {GRID}, j AS (SELECT g.meeting_id, win, min(start_ms * 1000 + position) AS first, speaker_label FROM grid g JOIN lines l ON g.meeting_id = l.meeting_id AND (start_ms + end_ms) / 2 >= w_start - 200 AND (start_ms + end_ms) / 2 <= w_end + 200 GROUP BY 1, 2, 4) SELECT meeting_id, win::BIGINT AS win, string_agg(speaker_label, ' ' ORDER BY first) AS text FROM j GROUP BY 1, 2")
def midpoint_texts(spark, sf):
    """Distinct labels, as texts, of the segments whose midpoint lies in each window."""
    from parley.plans.catalog import _grid

    d = model.lines(spark, sf).select("meeting_id", "start_ms", "end_ms", F.col("speaker_label").alias("text"))
    return intervals.midpoint_texts(d, _grid(spark, sf)).select("meeting_id", F.col("win").cast("bigint").alias("win"), "text")


@query(
    f"""WITH RECURSIVE {L}, e AS (SELECT meeting_id, list(start_ms ORDER BY position) AS xs, max(end_ms) AS stop FROM lines GROUP BY 1), walk AS (SELECT meeting_id, xs, stop, 1 AS i, CASE WHEN xs[1] >= 15000 AND stop - xs[1] >= 15000 THEN xs[1] ELSE 0 END AS last, xs[1] >= 15000 AND stop - xs[1] >= 15000 AS keep FROM e
UNION ALL SELECT meeting_id, xs, stop, i + 1, CASE WHEN xs[i + 1] - last >= 15000 AND stop - xs[i + 1] >= 15000 THEN xs[i + 1] ELSE last END, xs[i + 1] - last >= 15000 AND stop - xs[i + 1] >= 15000 FROM walk WHERE i < len(xs)) SELECT meeting_id, xs[i] AS at_ms FROM walk WHERE keep"""
)
def spaced_points(spark, sf):
    lines = model.lines(spark, sf)
    d = lines.select("meeting_id", F.col("start_ms").alias("at_ms"), F.max("end_ms").over(Window.partitionBy("meeting_id")).alias("stop_ms"))
    return intervals.spaced(d, "meeting_id", "stop_ms", 15_000)


FRAMES = f"""{L}, f AS (SELECT meeting_id, position AS i, position * 0.5::DOUBLE AS center, CASE WHEN position % 4 <> 3 THEN speaker_label END AS label FROM lines),
n AS (SELECT *, list_filter([lag(label) OVER w, label, lead(label) OVER w], lambda x: x IS NOT NULL) AS near FROM f WINDOW w AS (PARTITION BY meeting_id ORDER BY i)),
v AS (SELECT *, (SELECT arg_min(x, printf('%d%d', 3 - len(list_filter(near, lambda y: y = x)), CASE WHEN x = label THEN 0 ELSE 1 END) || x) FROM (SELECT unnest(list_distinct(near)) AS x)) AS voted FROM n),
sm AS (SELECT meeting_id, i, center, coalesce(last_value(voted IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY i), first_value(voted IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS smooth FROM v)"""


def _frames(spark, sf):
    label = F.when(F.pmod("position", F.lit(4)) != 3, F.col("speaker_label"))
    return model.lines(spark, sf).select("meeting_id", F.col("position").alias("i"), (F.col("position") * 0.5).alias("center"), label.alias("label"))


@query(f"WITH {FRAMES} SELECT meeting_id, i, smooth FROM sm")
def smoothed_frames(spark, sf):
    return intervals.smooth_labels(_frames(spark, sf), "meeting_id", "i").select("meeting_id", "i", "smooth")


@query(f"WITH {FRAMES}, b AS (SELECT meeting_id, (center + lead(center) OVER w) / 2 AS at, smooth AS from_label, lead(smooth) OVER w AS to_label FROM sm WINDOW w AS (PARTITION BY meeting_id ORDER BY i)) SELECT * FROM b WHERE to_label <> from_label")
def run_bounds(spark, sf):
    return intervals.run_bounds(intervals.smooth_labels(_frames(spark, sf), "meeting_id", "i"), "meeting_id", "i", "center")


@query(f"WITH {FRAMES}, b AS (SELECT meeting_id, (center + lead(center) OVER w) / 2 AS at, smooth AS from_label, lead(smooth) OVER w AS to_label FROM sm WINDOW w AS (PARTITION BY meeting_id ORDER BY i)), q AS (SELECT meeting_id, start_ms / 4000.0 AS t, (position * 7 % 5)::DOUBLE AS rms FROM lines), c AS (SELECT * FROM b WHERE to_label <> from_label), sn AS (SELECT c.meeting_id, c.at, arg_min(t, {{'rms': rms, 't': t}}) AS quiet FROM c JOIN q ON c.meeting_id = q.meeting_id AND abs(t - c.at) <= 0.75 GROUP BY 1, 2) SELECT c.meeting_id, c.at AS bound, coalesce(quiet, c.at) AS at FROM c LEFT JOIN sn ON c.meeting_id = sn.meeting_id AND c.at = sn.at")
def snapped_bounds(spark, sf):
    b = intervals.run_bounds(intervals.smooth_labels(_frames(spark, sf), "meeting_id", "i"), "meeting_id", "i", "center").withColumn("was", F.col("at"))
    q = model.lines(spark, sf).select("meeting_id", (F.col("start_ms") / 4000).alias("t"), F.pmod(F.col("position") * 7, F.lit(5)).cast("double").alias("rms"))
    return intervals.snap_to_quiet(b, q, "meeting_id").select("meeting_id", F.col("was").alias("bound"), "at")


@query(f"WITH {FRAMES}, c AS (SELECT meeting_id, (i // 3)::BIGINT AS span, smooth, count(*) AS n FROM sm GROUP BY 1, 2, 3) SELECT meeting_id, span, arg_min(smooth, {{'n': -n, 's': smooth}}) AS label FROM c GROUP BY 1, 2")
def dominant_in_spans(spark, sf):
    f = intervals.smooth_labels(_frames(spark, sf), "meeting_id", "i")
    spans = f.select("meeting_id", F.floor(F.col("i") / 3).alias("span")).distinct().select("meeting_id", "span", (F.col("span") * 1.5).alias("from_t"), (F.col("span") * 1.5 + 1.5).alias("to_t"))
    return intervals.dominant_in_span(spans, f, "meeting_id")


@query()
def absorbed_pieces(spark, sf):
    d = model.lines(spark, sf).select("meeting_id", (F.col("start_ms") / 10_000).alias("start"), (F.col("end_ms") / 10_000).alias("stop"), F.col("speaker_label").alias("label"))
    return intervals.absorb_short(d, "meeting_id")


@query(f"WITH {L}, sc AS (SELECT meeting_id, unnest(range(0, max(end_ms) // 1000 + 1)) AS t FROM lines GROUP BY 1), v AS (SELECT *, t % 60 < 20 AS is_speech, max(t) OVER (PARTITION BY meeting_id) + 1 AS total FROM sc), wn AS (SELECT meeting_id, CASE WHEN total <= 60 THEN 0 ELSE t // 25 END::INT AS win, min(t) AS from_t, max(t) + 1 AS to_t, avg(is_speech::INT) AS ratio FROM v GROUP BY 1, 2) SELECT meeting_id, win, from_t, to_t, round(ratio, 6) AS ratio FROM wn WHERE ratio >= 0.05")
def speech_windows(spark, sf):
    s = model.lines(spark, sf).groupBy("meeting_id").agg(F.floor(F.max("end_ms") / 1000).alias("stop"))
    s = s.select("meeting_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("stop"))).alias("t")).withColumn("is_speech", F.pmod("t", F.lit(60)) < 20)
    return intervals.tumbling_speech(s, "meeting_id").withColumn("ratio", F.round("ratio", 6))


# ---------------------------------------------------------------- search and insights


@query(f"WITH {L} SELECT DISTINCT meeting_id, position, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> '')) AS token FROM lines")
def inverted_index(spark, sf):
    return search.inverted_index(model.lines(spark, sf))


@query(f"WITH {L}, {M}, nw AS (SELECT id FROM meetings WHERE id IN (SELECT meeting_id FROM lines) AND deleted_at IS NULL ORDER BY uploaded_at DESC, id DESC LIMIT 20) SELECT meeting_id, string_agg(text, ' ' ORDER BY position) AS content FROM lines WHERE meeting_id IN (SELECT id FROM nw WHERE id <> 1) GROUP BY 1")
def background_texts(spark, sf):
    lines = model.lines(spark, sf)
    held = model.meetings(spark, sf).join(lines.select(F.col("meeting_id").alias("id")).distinct(), "id", "left_semi")
    d = search.background(held, lines, 1).groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("xs"))
    return d.select("meeting_id", F.array_join(F.transform("xs", lambda x: x["text"]), " ").alias("content"))


@query(f"WITH {L} SELECT meeting_id, position FROM lines WHERE text LIKE '%e, %' ESCAPE '\\'")
def like_search(spark, sf):
    pattern = "%" + search.like_escape("e, ") + "%"
    return model.lines(spark, sf).filter(F.col("text").like(pattern)).select("meeting_id", "position")


@query(f"WITH {L}, sp AS (SELECT meeting_id, position, string_split(speaker, ' + ') AS xs FROM lines), u AS (SELECT meeting_id, position, unnest(xs) AS x, unnest(range(len(xs))) AS i FROM sp), f AS (SELECT meeting_id, x, min(position * 100 + i) AS first FROM u GROUP BY 1, 2) SELECT meeting_id, string_agg(x, '|' ORDER BY first) AS topics FROM f GROUP BY 1")
def ordered_unions(spark, sf):
    d = model.lines(spark, sf).select("meeting_id", "position", F.split("speaker", r" \+ ").alias("topics"))
    return insights.ordered_union(d, "position", "topics").withColumn("topics", F.array_join("topics", "|"))


@query(f"WITH {L}, n AS (SELECT meeting_id, lower(speaker) AS name, arg_min(color, position) AS color FROM lines GROUP BY 1, 2) SELECT * FROM n")
def speaker_colors(spark, sf):
    return insights.colors(model.lines(spark, sf))


@query(f"WITH {L} SELECT meeting_id, position, CASE WHEN position % 2 = 0 THEN speaker ELSE speaker_label END AS pending, CASE WHEN position % 3 = 0 THEN 'Done' ELSE 'Pending' END AS status, speaker AS commitment, CASE WHEN position % 2 = 0 THEN 'Friday' ELSE 'No deadline' END AS timing FROM lines")
def displayed_insights(spark, sf):
    p = lambda n: F.pmod("position", F.lit(n))
    d = model.lines(spark, sf).select(
        "meeting_id", "position", F.struct(F.when(p(2) == 0, F.col("speaker")).alias("description"), F.col("speaker_label").alias("topic"), F.when(p(3) == 0, "Done").alias("status")).alias("a"),
        F.struct(F.col("speaker").alias("action"), F.when(p(2) == 0, "Friday").alias("timing")).alias("b"),
    )
    a, b = insights.display_insight(F.col("a"), F.col("b"))
    return d.select("meeting_id", "position", a["text"].alias("pending"), a["status"].alias("status"), b["text"].alias("commitment"), b["timing"].alias("timing"))


def _proposed(spark, sf):
    """Every saying proposed as a decision and an action; every third quotes itself, the next ones what nobody said, or nothing."""
    k = F.pmod("position", F.lit(3))
    quote = F.when(k == 0, F.col("text")).when(k == 1, "entirely invented words were never spoken")
    own = F.when(k == 0, "I").when(k == 1, "Asha").otherwise("nobody")
    return said(spark, sf).select("meeting_id", F.col("position").alias("item"), "text", F.col("text").alias("title"), quote.alias("quote"), own.alias("owner"), F.when(k == 2, "Friday").otherwise("none").alias("due"))


@query()
def decisions(spark, sf):
    return insights.collect_decisions(_proposed(spark, sf), said(spark, sf))


@query()
def actions(spark, sf):
    return insights.collect_actions(_proposed(spark, sf), said(spark, sf))


@query()
def meeting_insights(spark, sf):
    d = insights.insights(insights.collect_actions(_proposed(spark, sf), said(spark, sf)))
    return d.select("meeting_id", *[F.size(c).alias(c) for c in ("commitments", "deadlines", "pending", "attention_needed")])


@query()
def kept_and_dropped(spark, sf):
    p = _proposed(spark, sf)
    return insights.kept_and_dropped(p, insights.collect_decisions(p, said(spark, sf)))


# ---------------------------------------------------------------- search through an index


def _indexed(spark, sf):
    """An index over meetings and sayings, in the shared folder."""
    return SearchIndex.build(model.meetings(spark, sf), said(spark, sf), f"{shared_folder(spark)}/search-index-{uuid.uuid4().hex}", buckets=16)


def _hits(test: str, title: str) -> str:
    return f"""WITH {SAID}, {M}, h AS (SELECT *, count(*) OVER (PARTITION BY meeting_id)::INT AS match_count, row_number() OVER (PARTITION BY meeting_id ORDER BY position) AS r FROM said WHERE {test}),
found AS (SELECT * FROM meetings WHERE deleted_at IS NULL AND (id IN (SELECT meeting_id FROM h) OR {title}) ORDER BY uploaded_at DESC, id DESC LIMIT 50)
SELECT id, coalesce(max(match_count), 0)::INT AS match_count, (coalesce(max(match_count), 0) - count(*) FILTER (r <= 5))::INT AS hidden, string_agg(position || ':' || h.text, '|' ORDER BY position) FILTER (r <= 5) AS shown FROM found LEFT JOIN h ON id = meeting_id GROUP BY id"""


def _shown(found):
    shown = F.array_join(F.transform("matches", lambda m: F.concat(m["position"].cast("string"), F.lit(":"), m["text"])), "|")
    return found.select("id", "match_count", "hidden", F.nullif(shown, F.lit("")).alias("shown"))


@query(_hits("contains(lower(text), 'करत')", "contains(lower(title), 'करत') OR contains(lower(agenda), 'करत')"))
def indexed_search_inside_words(spark, sf):
    """A Devanagari stem inside an inflected word, which no token equals."""
    return _shown(_indexed(spark, sf).search("करत"))


@query(_hits("contains(lower(text), 'my na')", "contains(lower(title), 'my na') OR contains(lower(agenda), 'my na')"))
def indexed_search_substring(spark, sf):
    return _shown(_indexed(spark, sf).search("MY na", tokens=False))


TOKENS = "regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+')"
BOTH_TOKENS = f"(list_contains({TOKENS}, 'asha') AND list_contains({TOKENS}, 'hello'))"


@query(_hits(f"contains(lower(text), 'asha hello') OR {BOTH_TOKENS.format('text', 'text')}", f"contains(lower(title), 'asha hello') OR contains(lower(agenda), 'asha hello') OR {BOTH_TOKENS.format(*['concat_ws(chr(32), title, agenda)'] * 2)}"))
def indexed_search_tokens(spark, sf):
    """Tokens in any order and place."""
    return _shown(_indexed(spark, sf).search("asha hello"))


@query(_hits("contains(lower(text), 'sync 1')", "contains(lower(title), 'sync 1') OR contains(lower(agenda), 'sync 1')"))
def indexed_search_title(spark, sf):
    return _shown(_indexed(spark, sf).search("Sync 1", tokens=False))
