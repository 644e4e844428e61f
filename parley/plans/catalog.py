"""Registered queries over the meeting model, each beside the DuckDB SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import scalar as S
from parley.functions import text as X
from parley.functions import vocabulary as V
from parley.operators import dashboard as D
from parley.operators import clustering, insights, intervals, quotes, search, store, turns, vectors
from parley.operators import talk_time as _talk
from parley.sources import duck, model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
L, M, VO, T = duck.LINES, duck.MEETINGS, duck.VOICES, duck.TURNS
AS_OF = model.AS_OF


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# ---------------------------------------------------------------- store and lists


@query(f"WITH {M} SELECT id, title, uploaded_at, status FROM meetings WHERE deleted_at IS NULL ORDER BY uploaded_at DESC, id DESC LIMIT 3")
def list_recent(spark, sf):
    return _ntz(D.newest(model.meetings(spark, sf), 3).select("id", "title", "uploaded_at", "status"))


@query(f"WITH {M} SELECT id, deleted_at FROM meetings WHERE deleted_at IS NOT NULL")
def trash_list(spark, sf):
    return _ntz(D.trash(model.meetings(spark, sf)).select("id", "deleted_at"))


@query(f"WITH {M} SELECT id, title, status FROM meetings WHERE id = 42 AND deleted_at IS NULL")
def point_lookup(spark, sf):
    return D.point(model.meetings(spark, sf), 42).select("id", "title", "status")


@query(f"WITH {M} SELECT id, coalesce(meeting_type, 'internal') AS meeting_type, coalesce(department, 'AI Team') AS department FROM meetings")
def read_defaults(spark, sf):
    return D.with_defaults(model.meetings(spark, sf)).select("id", "meeting_type", "department")


@query(f"WITH {M} SELECT id FROM meetings WHERE uploaded_at IS NULL OR epoch(TIMESTAMP '{AS_OF}') - epoch(uploaded_at) <= 7 * 86400")
def range_7d(spark, sf):
    return D.in_range(model.meetings(spark, sf), "7d", AS_OF).select("id")


@query(f"WITH {M} SELECT id FROM meetings WHERE lower(status) = 'completed' AND lower(coalesce(department, 'AI Team')) = 'ai team'")
def facet_filter(spark, sf):
    return D.facets(model.meetings(spark, sf), status="completed", department="AI team").select("id")


@query(f"WITH {M} SELECT id FROM (SELECT id, row_number() OVER (ORDER BY uploaded_at DESC, id DESC) AS r FROM meetings WHERE deleted_at IS NULL) WHERE r BETWEEN 17 AND 24")
def page_three(spark, sf):
    return D.page(model.meetings(spark, sf), 3).select("id")


@query(f"WITH {M} SELECT greatest(ceil(count(*) / 8.0), 1)::INT AS pages FROM meetings WHERE deleted_at IS NULL")
def page_count(spark, sf):
    return D.pages(model.meetings(spark, sf))


@query(f"WITH {M} SELECT id FROM meetings WHERE status = 'Processing' AND deleted_at IS NULL ORDER BY uploaded_at DESC, id DESC LIMIT 5")
def processing_notifications(spark, sf):
    return D.notifications(model.meetings(spark, sf)).select("id")


@query("SELECT * FROM (VALUES ('en', 'English'), ('hi', 'Hindi'), ('mr', 'Marathi')) t(code, name)")
def language_dimension(spark, sf):
    return model.languages(spark)


@query(f"WITH {M} SELECT id, CASE WHEN deleted_at IS NULL AND owner_id = 7 THEN TIMESTAMP '{AS_OF}' ELSE deleted_at END AS deleted_at FROM meetings")
def soft_delete(spark, sf):
    return _ntz(store.soft_delete(model.meetings(spark, sf), F.col("owner_id") == 7, AS_OF).select("id", "deleted_at"))


@query(f"WITH {M} SELECT id, CASE WHEN owner_id <> 7 THEN deleted_at END AS deleted_at FROM meetings")
def restore_meetings(spark, sf):
    return _ntz(store.restore(model.meetings(spark, sf), F.col("owner_id") == 7).select("id", "deleted_at"))


@query(f"WITH {L}, {M} SELECT meeting_id, position FROM lines WHERE meeting_id IN (SELECT id FROM meetings WHERE deleted_at IS NULL)")
def purge_cascade(spark, sf):
    _, (left,), _ = store.purge(model.meetings(spark, sf), [model.lines(spark, sf)])
    return left.select("meeting_id", "position")


@query(f"WITH {M} SELECT id, title, CASE WHEN id = 5 THEN 0 ELSE duration_seconds END AS duration_seconds, CASE WHEN id = 5 THEN 'Completed' ELSE status END AS status FROM meetings")
def update_meeting(spark, sf):
    return store.update(model.meetings(spark, sf), 5, duration_seconds=0.0, status="Completed").select("id", "title", "duration_seconds", "status")


@query(f"WITH {L} SELECT meeting_id, position, array_to_string(list_transform(string_split(speaker, ' + '), lambda x: CASE WHEN x = 'Asha' THEN 'Anita' ELSE x END), ' + ') AS speaker FROM lines")
def rename_speaker(spark, sf):
    return store.rename_speaker(model.lines(spark, sf), "Asha", "Anita").select("meeting_id", "position", "speaker")


@query(f"WITH {L} SELECT meeting_id, position FROM lines WHERE NOT (lower(speaker) = 'ravi' OR lower(speaker_label) = 'ravi')")
def delete_speaker(spark, sf):
    return store.delete_speaker(model.lines(spark, sf), " RAVI ").select("meeting_id", "position")


@query(f"WITH {L} SELECT meeting_id, position, CASE WHEN speaker = 'Asha' THEN speaker_label ELSE speaker END AS speaker FROM lines")
def revert_speaker(spark, sf):
    return store.revert_speaker(model.lines(spark, sf), "Asha").select("meeting_id", "position", "speaker")


@query(
    f"""WITH {L}, c AS (SELECT meeting_id, round(start_ms / 1000, 2) AS k, arg_max('Meera ' || position % 2, position) AS t FROM lines WHERE position IN (1, 4) GROUP BY ALL),
m AS (SELECT meeting_id, max(regexp_extract(speaker_label, '([0-9]+)$', 1)::INT) AS top FROM lines GROUP BY 1),
j AS (SELECT l.*, t, top FROM lines l LEFT JOIN c ON l.meeting_id = c.meeting_id AND round(start_ms / 1000, 2) = k JOIN m ON l.meeting_id = m.meeting_id),
o AS (SELECT meeting_id, t, row_number() OVER (PARTITION BY meeting_id ORDER BY min(position)) AS nth FROM j WHERE t IS NOT NULL GROUP BY 1, 2)
SELECT j.meeting_id, position, coalesce(j.t, speaker) AS speaker, CASE WHEN j.t IS NULL THEN speaker_label ELSE 'Speaker_' || lpad((top + nth)::VARCHAR, 2, '0') END AS speaker_label FROM j LEFT JOIN o ON j.meeting_id = o.meeting_id AND j.t = o.t"""
)
def reassign_by_start(spark, sf):
    lines = model.lines(spark, sf)
    changes = lines.filter("position IN (1, 4)").select("meeting_id", (F.col("start_ms") / 1000).alias("start_sec"), F.concat(F.lit("Meera "), F.pmod("position", F.lit(2))).alias("new_speaker"), F.lit(None).cast("string").alias("new_label"), F.col("position").alias("seq"))
    return store.reassign(lines, changes).select("meeting_id", "position", "speaker", "speaker_label")


@query(f"WITH {M} SELECT id, title FROM meetings WHERE id % 3 = 0 UNION ALL SELECT id, 'imported' FROM meetings WHERE id % 5 = 0 AND id % 3 <> 0")
def import_reconcile(spark, sf):
    m = model.meetings(spark, sf).select("id", "title")
    return store.reconcile(m.filter("id % 5 = 0").withColumn("title", F.lit("imported")), m.filter("id % 3 = 0"))


@query(f"WITH {M} SELECT id, 'title' AS differs, true AS in_source, true AS in_store FROM meetings WHERE id % 100 = 0")
def import_verification(spark, sf):
    m = model.meetings(spark, sf)
    other = m.withColumn("title", F.when(F.col("id") % 100 == 0, "other").otherwise(F.col("title")))
    return store.verify_import(m, other, ["title", "status"]).withColumn("differs", F.array_join("differs", ","))


@query(f"WITH {M} SELECT id FROM meetings WHERE status = 'Failed' AND deleted_at IS NULL")
def requeue_failed(spark, sf):
    return store.requeue_failed(model.meetings(spark, sf))


@query(f"WITH {L}, {M} SELECT 'lines.meeting exists' AS rule, meeting_id::VARCHAR AS key FROM lines WHERE meeting_id NOT IN (SELECT id FROM meetings WHERE id % 2 = 0)")
def constraint_violations(spark, sf):
    return store.violations(model.meetings(spark, sf).filter("id % 2 = 0"), model.lines(spark, sf))


@query(f"WITH {L}, {M} SELECT id, count(meeting_id)::INT AS line_count, coalesce(string_agg(speaker, '|' ORDER BY position), '') AS speakers FROM meetings LEFT JOIN lines ON id = meeting_id GROUP BY id")
def meeting_documents(spark, sf):
    d = store.documents(model.meetings(spark, sf), model.lines(spark, sf))
    return d.select("id", "line_count", F.array_join(F.transform("transcript", lambda x: x["speaker"]), "|").alias("speakers"))


@query(
    f"""WITH {L}, {M} SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') || '-transcript.txt' AS file_name,
  title || chr(10) || string_agg('[' || lpad(((start_ms // 60000))::VARCHAR, 2, '0') || ':' || lpad((start_ms // 1000 % 60)::VARCHAR, 2, '0') || '] ' || speaker || ' (' || coalesce(language, '') || '): ' || text, chr(10) ORDER BY position) AS content
FROM meetings JOIN lines ON id = meeting_id GROUP BY id, title"""
)
def export_text(spark, sf):
    return store.export_text(model.meetings(spark, sf), model.lines(spark, sf))


# ---------------------------------------------------------------- dashboard


@query(f"WITH {M} SELECT count(*) AS total, count(*) FILTER (status = 'Completed') AS completed, count(*) FILTER (status = 'Processing') AS processing, count(*) FILTER (status = 'Failed') AS failed FROM meetings")
def status_counts(spark, sf):
    return D.by_status(model.meetings(spark, sf))


@query(f"WITH {M}, c AS (SELECT CASE WHEN meeting_type = 'client' THEN 'client' ELSE 'internal' END AS category, count(*) AS n FROM meetings GROUP BY 1) SELECT *, floor(100.0 * n / sum(n) OVER () + 0.5)::INT AS pct FROM c")
def category_pct(spark, sf):
    return D.category_share(model.meetings(spark, sf))


@query(f"WITH {M}, c AS (SELECT coalesce(department, 'AI Team') AS department, count(*) AS n FROM meetings GROUP BY 1 ORDER BY n DESC, department LIMIT 5) SELECT *, round(100.0::DOUBLE * n / max(n) OVER (), 1) AS width FROM c")
def dept_top5(spark, sf):
    return D.top_departments(model.meetings(spark, sf))


@query(
    f"""WITH {M}, s AS (SELECT unnest(generate_series(DATE '{AS_OF[:10]}' - 6, DATE '{AS_OF[:10]}', INTERVAL 1 DAY))::DATE AS day),
c AS (SELECT s.day, count(id) AS n FROM s LEFT JOIN meetings ON uploaded_at::DATE = s.day GROUP BY 1)
SELECT day::VARCHAR AS day, n, day = DATE '{AS_OF[:10]}' AS is_today, CASE WHEN n > 0 THEN greatest(round(100.0::DOUBLE * n / max(n) OVER (), 1), 14) ELSE 0 END::DOUBLE AS bar FROM c"""
)
def daily_uploads_7d(spark, sf):
    return D.daily_uploads(model.meetings(spark, sf), AS_OF).withColumn("day", F.col("day").cast("string"))


@query(f"WITH {M} SELECT round(sum(duration_seconds) / 60)::BIGINT AS minutes, round(avg(duration_seconds)) AS mean_seconds, CASE WHEN round(avg(duration_seconds)) < 60 THEN round(avg(duration_seconds))::BIGINT || ' sec' END AS mean_label FROM meetings")
def duration_totals(spark, sf):
    return D.durations(model.meetings(spark, sf))


@query(f"WITH {M} SELECT id, duration_seconds FROM meetings ORDER BY coalesce(duration_seconds, 0) DESC, id LIMIT 10")
def duration_ranking(spark, sf):
    return D.longest(model.meetings(spark, sf)).select("id", "duration_seconds")


@query(f"WITH {M} SELECT id, CASE WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS label, printf('%02d:%02d', f // 60, f % 60) AS time FROM (SELECT id, round(duration_seconds)::BIGINT AS s, floor(duration_seconds)::BIGINT AS f FROM meetings)")
def duration_labels(spark, sf):
    return model.meetings(spark, sf).select("id", S.duration_label(F.col("duration_seconds")).alias("label"), S.time_label(F.col("duration_seconds")).alias("time"))


# ---------------------------------------------------------------- turns and talk time


@query(f"WITH {T} SELECT meeting_id, turn, speaker_label, start_ms, end_ms, segments FROM turns")
def turn_merge(spark, sf):
    d = turns.number_turns(model.lines(spark, sf))
    o = F.struct("start_ms", "position")
    return d.groupBy("meeting_id", "turn").agg(F.min_by("speaker_label", o).alias("speaker_label"), F.min("start_ms").alias("start_ms"), F.max_by("end_ms", o).alias("end_ms"), F.count("*").cast("int").alias("segments"))


@query(
    f"""WITH {T}, t AS (SELECT meeting_id, speaker_label, sum(end_ms - start_ms)::BIGINT AS ms FROM turns GROUP BY ALL)
SELECT meeting_id, speaker_label, ms, round(100.0::DOUBLE * ms / sum(ms) OVER (PARTITION BY meeting_id), 1) AS pct FROM t WHERE ms > 0"""
)
def talk_time_turns(spark, sf):
    o = F.struct("start_ms", "position")
    d = turns.number_turns(model.lines(spark, sf)).groupBy("meeting_id", "turn").agg(F.min_by("speaker_label", o).alias("speaker_label"), F.min("start_ms").alias("start_ms"), F.max_by("end_ms", o).alias("end_ms"))
    by = d.groupBy("meeting_id", "speaker_label").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms")).filter("ms > 0")
    return by.withColumn("pct", F.round(100 * F.col("ms") / F.sum("ms").over(Window.partitionBy("meeting_id")), 1))


SHARES = f"""{L}, o AS (SELECT meeting_id, position, color, end_ms - start_ms AS dur, CASE WHEN is_overlap THEN candidate_speakers WHEN contains(speaker, '+') THEN string_split(speaker, ' + ') ELSE [speaker] END AS owners FROM lines WHERE end_ms > start_ms),
e AS (SELECT meeting_id, position, color, dur / len(owners) AS ms, unnest(owners) AS name, unnest(range(len(owners))) AS i FROM o),
g AS (SELECT meeting_id, name, sum(ms) AS ms, min(position * 100 + i) AS first, arg_min(color, position * 100 + i) AS color FROM e GROUP BY 1, 2),
n AS (SELECT *, max(NOT regexp_matches(name, '(?i)^speaker[_ ]?[0-9]+$')) OVER (PARTITION BY meeting_id) AS named FROM g),
k AS (SELECT * FROM n WHERE NOT (named AND regexp_matches(name, '(?i)^speaker[_ ]?[0-9]+$') AND ms < 5000)),
shares AS (SELECT meeting_id, name, ms, round(100 * ms / sum(ms) OVER (PARTITION BY meeting_id), 1) AS pct, row_number() OVER (PARTITION BY meeting_id ORDER BY ms DESC, first)::INT AS rank, color FROM k)"""


@query(f"WITH {SHARES} SELECT meeting_id, name, round(ms, 3) AS ms, pct, rank, color FROM shares")
def talk_time(spark, sf):
    return _shares(spark, sf).withColumn("ms", F.round("ms", 3))


def _shares(spark, sf):
    return _talk.shares(model.lines(spark, sf))


@query(f"WITH {L}, t AS (SELECT meeting_id, speaker AS name, sum(greatest(end_ms - start_ms, 0))::BIGINT AS ms, min(position) AS first FROM lines GROUP BY 1, 2) SELECT meeting_id, name, ms, CASE WHEN sum(ms) OVER w > 0 THEN round(100.0::DOUBLE * ms / sum(ms) OVER w, 1) ELSE 0 END AS pct, (row_number() OVER (PARTITION BY meeting_id ORDER BY first) - 1)::INT AS position FROM t WINDOW w AS (PARTITION BY meeting_id)")
def talk_time_stored(spark, sf):
    return _talk.plain_shares(model.lines(spark, sf))


@query(f"WITH {SHARES}, p AS (SELECT meeting_id, round(ms / 1000, 1) AS s FROM shares), q AS (SELECT *, 100 * s / sum(s) OVER (PARTITION BY meeting_id) AS share FROM p) SELECT meeting_id, greatest(count(*) FILTER (s >= 3 OR share >= 2), 1) AS participants FROM q GROUP BY 1")
def participants(spark, sf):
    return _talk.participants(_shares(spark, sf))


@query(f"WITH {L} SELECT meeting_id, count(DISTINCT speaker) AS participants FROM lines GROUP BY 1")
def participants_distinct(spark, sf):
    return _talk.distinct_participants(model.lines(spark, sf))


@query(f"WITH {L}, t AS (SELECT meeting_id, language AS code, sum(end_ms - start_ms)::DOUBLE AS ms FROM lines WHERE language IS NOT NULL AND end_ms > start_ms GROUP BY 1, 2), p AS (SELECT *, round(100 * ms / sum(ms) OVER (PARTITION BY meeting_id), 1) AS pct FROM t) SELECT * FROM p WHERE ms > 50")
def language_breakdown(spark, sf):
    return _talk.language_breakdown(model.lines(spark, sf))


@query(f"WITH {L}, t AS (SELECT meeting_id, language, count(*) AS n, min(position) AS first FROM lines WHERE language IS NOT NULL GROUP BY 1, 2), m AS (SELECT DISTINCT meeting_id FROM lines) SELECT meeting_id, coalesce(arg_max(language, n * 1000 - first), 'en') AS language FROM m LEFT JOIN t USING (meeting_id) GROUP BY 1")
def dominant_language(spark, sf):
    return _talk.dominant_language(model.lines(spark, sf))


@query(f"WITH {L} SELECT meeting_id, sum(end_ms - start_ms)::BIGINT AS spoken_ms, count(*) AS lines FROM lines GROUP BY 1")
def spoken_duration(spark, sf):
    return _talk.spoken_ms(model.lines(spark, sf))


@query(f"WITH {L}, t AS (SELECT meeting_id, speaker_label, sum(end_ms - start_ms) AS ms FROM lines GROUP BY 1, 2) SELECT meeting_id, count(*) AS labels, count(*) FILTER (ms < 5000) AS dust FROM t GROUP BY 1")
def dust_summary(spark, sf):
    return _talk.dust(model.lines(spark, sf))


@query(f"WITH {SHARES}, t AS (SELECT name, sum(ms) AS ms, arg_min(color, meeting_id * 1000 + rank) AS color FROM shares GROUP BY 1) SELECT name, round(ms, 3) AS ms, color, round(coalesce(sum(ms) OVER (ORDER BY ms DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(ms) OVER (), 6) AS arc_start, round(ms / sum(ms) OVER (), 6) AS share FROM t")
def talk_time_across(spark, sf):
    return D.across_meetings(_shares(spark, sf)).withColumn("ms", F.round("ms", 3))


@query(f"WITH {L}, f AS (SELECT meeting_id, speaker_label, min(position) AS first_position FROM lines GROUP BY 1, 2), r AS (SELECT *, (row_number() OVER (PARTITION BY meeting_id ORDER BY first_position) - 1)::INT AS speaker_no FROM f) SELECT *, (speaker_no % 10)::INT AS palette_slot FROM r")
def first_appearance_color(spark, sf):
    return turns.first_appearance(model.lines(spark, sf))


@query(f"WITH {L}, g AS (SELECT meeting_id, position, speaker_label, speaker, last_value(CASE WHEN speaker NOT LIKE 'Speaker%' THEN speaker END IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM lines) SELECT meeting_id, speaker_label, min(position) AS first_position, arg_min(p, position) FILTER (position = mp) AS previous_speaker FROM (SELECT *, min(position) OVER (PARTITION BY meeting_id, speaker_label) AS mp FROM g WHERE speaker LIKE 'Speaker%') GROUP BY 1, 2")
def previous_human(spark, sf):
    return turns.previous_human(model.lines(spark, sf))


@query(
    f"""WITH {L}, c AS (SELECT meeting_id, position, language, count(*) FILTER (language = 'en') OVER w AS en, count(*) FILTER (language = 'hi') OVER w AS hi,
  min(position) FILTER (language = 'en') OVER w AS pe, min(position) FILTER (language = 'hi') OVER w AS ph FROM lines WINDOW w AS (PARTITION BY meeting_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT meeting_id, position, CASE WHEN hi > en OR (hi = en AND hi > 0 AND ph < pe) THEN 'hi' ELSE 'en' END AS hint_language FROM c"""
)
def running_language(spark, sf):
    return turns.running_language(model.lines(spark, sf)).select("meeting_id", "position", "hint_language")


WINDOWS = (
    L.replace("w AS (", "RECURSIVE w AS (", 1)
    + """, walk AS (SELECT meeting_id, position, start_ms AS began, 0 AS win FROM lines WHERE position = 0
UNION ALL SELECT l.meeting_id, l.position, CASE WHEN l.start_ms - began >= 180000 THEN l.start_ms ELSE began END, CASE WHEN l.start_ms - began >= 180000 THEN win + 1 ELSE win END FROM walk JOIN lines l ON l.meeting_id = walk.meeting_id AND l.position = walk.position + 1)"""
)


@query(f"WITH {WINDOWS} SELECT meeting_id, position, win AS summary_window FROM walk")
def summary_windows(spark, sf):
    return turns.summary_windows(model.lines(spark, sf)).select("meeting_id", "position", "summary_window")


@query(f"WITH {WINDOWS} SELECT meeting_id, win AS summary_window, count(*) AS lines, string_agg(speaker || ': ' || text, chr(10) ORDER BY position) AS content FROM walk JOIN lines USING (meeting_id, position) GROUP BY 1, 2")
def summary_window_text(spark, sf):
    d = turns.summary_windows(model.lines(spark, sf)).groupBy("meeting_id", "summary_window").agg(F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct("position", "speaker", "text"))).alias("xs"))
    return d.select("meeting_id", "summary_window", "lines", F.array_join(F.transform("xs", lambda x: F.concat(x["speaker"], F.lit(": "), x["text"])), "\n").alias("content"))


@query(f"WITH {T} SELECT meeting_id, turn, (turn // 5)::INT AS batch FROM turns")
def turn_batches(spark, sf):
    return turns.in_batches(turns.number_turns(model.lines(spark, sf)).select("meeting_id", "turn").distinct())


@query()
def turns_full(spark, sf):
    return turns.merge_turns(model.lines(spark, sf)).select("meeting_id", "turn", "speaker", "speaker_label", "start_ms", "end_ms", "segments", "language", "raw_text", "text")


# ---------------------------------------------------------------- search and keywords

NEEDLE = "er the"
HITS = f"{L}, {M}, h AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY position) AS r, count(*) OVER (PARTITION BY meeting_id)::INT AS match_count FROM lines WHERE contains(lower(text), '{NEEDLE}')), found AS (SELECT * FROM meetings WHERE deleted_at IS NULL AND (id IN (SELECT meeting_id FROM h) OR contains(lower(title), '{NEEDLE}') OR contains(lower(agenda), '{NEEDLE}')) ORDER BY uploaded_at DESC, id DESC LIMIT 50)"


@query(f"WITH {HITS} SELECT id, title, coalesce(max(match_count), 0)::INT AS match_count, (coalesce(max(match_count), 0) - count(meeting_id) FILTER (r <= 5))::INT AS hidden FROM found LEFT JOIN h ON id = meeting_id GROUP BY id, title")
def search_substring(spark, sf):
    return search.search(model.meetings(spark, sf), model.lines(spark, sf), NEEDLE, tokens=False).select("id", "title", "match_count", "hidden")


@query(f"WITH {HITS} SELECT id, match_count, (r - 1)::INT AS snippet, position, speaker, language, text FROM found JOIN h ON id = meeting_id WHERE r <= 5")
def search_snippets(spark, sf):
    return search.flat_snippets(search.search(model.meetings(spark, sf), model.lines(spark, sf), NEEDLE, tokens=False))


TOKENISED = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> '')"


def _token_search(needle: str, a: str, b: str) -> str:
    test = lambda t: f"(list_contains({t}, '{a}') AND list_contains({t}, '{b}'))"
    return f"""WITH {L}, {M}, t AS (SELECT *, {TOKENISED.format("text")} AS tk FROM lines),
h AS (SELECT meeting_id, count(*)::INT AS match_count FROM t WHERE contains(lower(text), '{needle}') OR {test("tk")} GROUP BY 1),
m AS (SELECT *, {TOKENISED.format("concat_ws(' ', title, agenda)")} AS tk FROM meetings WHERE deleted_at IS NULL)
SELECT id, coalesce(match_count, 0)::INT AS match_count FROM m LEFT JOIN h ON id = meeting_id WHERE match_count IS NOT NULL OR contains(lower(title), '{needle}') OR contains(lower(agenda), '{needle}') OR {test("tk")}
ORDER BY uploaded_at DESC, id DESC LIMIT 50"""


@query(_token_search("the of", "the", "of"))
def search_tokens(spark, sf):
    return search.search(model.meetings(spark, sf), model.lines(spark, sf), "the of").select("id", "match_count")


@query(_token_search("k sync", "k", "sync"))
def search_title_and_agenda(spark, sf):
    """Tokens of which one stands in the title and the other in the agenda."""
    return search.search(model.meetings(spark, sf), model.lines(spark, sf), "k SYNC").select("id", "match_count")


@query(f"WITH {L} SELECT meeting_id, position FROM lines WHERE contains(lower(text), 'tion the')")
def search_in_meeting(spark, sf):
    return search.in_meeting(model.lines(spark, sf), "tion THE").select("meeting_id", "position")


@query(f"WITH {HITS} SELECT m.id, coalesce(match_count, 0)::INT AS match_count FROM meetings m LEFT JOIN (SELECT DISTINCT id, match_count FROM found LEFT JOIN h ON id = meeting_id) f ON m.id = f.id")
def search_with_listed(spark, sf):
    m = model.meetings(spark, sf)
    return search.with_listed(m, search.search(m, model.lines(spark, sf), NEEDLE, tokens=False)).select("id", "match_count")


@query(f"WITH {L} SELECT meeting_id, position, regexp_replace(text, '(?i)(tion)', '<mark>\\1</mark>', 'g') AS marked FROM lines")
def search_highlight(spark, sf):
    return model.lines(spark, sf).select("meeting_id", "position", X.highlight(F.col("text"), "tion").alias("marked"))


@query(f"WITH {L} SELECT meeting_id, position, start_ms, end_ms FROM lines WHERE lower(trim(speaker)) = 'asha' OR speaker_label = 'Speaker_02'")
def speaker_ranges(spark, sf):
    return search.speaker_ranges(model.lines(spark, sf), "asha", "Speaker_02")


TOKENS = f"{L}, k AS (SELECT meeting_id, unnest(regexp_extract_all(lower(text), '[A-Za-z{X.DEVANAGARI_WORD}]{{3,}}')) AS word FROM lines), c AS (SELECT meeting_id, word, count(*) AS count FROM k WHERE word NOT IN ({quoted(V.STOP_WORDS_ENGLISH + V.STOP_WORDS_DEVANAGARI)}) GROUP BY 1, 2)"


def _counts(spark, sf):
    return search.term_counts(model.lines(spark, sf), V.STOP_WORDS_ENGLISH + V.STOP_WORDS_DEVANAGARI)


@query(f"WITH {TOKENS} SELECT * FROM c")
def term_freq(spark, sf):
    return _counts(spark, sf)


@query(
    f"""WITH {TOKENS}, n AS (SELECT count(DISTINCT meeting_id) + 1 AS n FROM c), f AS (SELECT word, count(DISTINCT meeting_id) + 1 AS df FROM c GROUP BY 1),
m AS (SELECT *, max(count) OVER (PARTITION BY meeting_id) AS most FROM c),
kw AS (SELECT meeting_id, word, count, round(count * ln(n / df), 6) AS score FROM m JOIN f USING (word), n WHERE count >= 2 OR most < 2),
r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY score DESC, count DESC, word DESC)::INT AS rank FROM kw) SELECT * FROM r WHERE rank <= 12"""
)
def keywords_tfidf(spark, sf):
    c = _counts(spark, sf)
    return search.keywords(c, c.select("meeting_id", "word"))


@query(f"WITH {L} SELECT meeting_id, position, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(text, '[^ऀ-ॿ]', '', 'g')) AS devanagari FROM lines")
def script_counts(spark, sf):
    return model.lines(spark, sf).select("meeting_id", "position", X.letters(F.col("text"), "latin").cast("bigint").alias("latin"), X.letters(F.col("text"), "devanagari").cast("bigint").alias("devanagari"))


@query(f"WITH {L} SELECT meeting_id, position, trim(regexp_replace(trim(lower(text), ' .,!?-\"''।'), '\\s+', ' ', 'g')) AS normal FROM lines")
def normalised_text(spark, sf):
    return model.lines(spark, sf).select("meeting_id", "position", F.trim(X.normalise(F.col("text"))).alias("normal"))


# ---------------------------------------------------------------- joins on time


@query(
    f"""WITH {L}, o AS (SELECT meeting_id, position, start_ms, end_ms + 9000 AS end_ms, speaker FROM lines),
q AS (SELECT meeting_id, unnest(range(0, max(end_ms) + 7000, 7000)) AS t_ms FROM o GROUP BY 1),
h AS (SELECT q.meeting_id, t_ms, arg_min(speaker, start_ms * 10000 + position) AS speaker FROM q JOIN o ON q.meeting_id = o.meeting_id AND t_ms >= start_ms AND t_ms < end_ms GROUP BY 1, 2),
b AS (SELECT q.meeting_id, t_ms, arg_max(speaker, start_ms * 10000 + position) AS speaker FROM q JOIN o ON q.meeting_id = o.meeting_id AND t_ms >= start_ms GROUP BY 1, 2)
SELECT q.meeting_id, q.t_ms, CASE WHEN h.t_ms IS NOT NULL THEN h.speaker ELSE b.speaker END AS speaker, h.t_ms IS NOT NULL AS inside FROM q LEFT JOIN h USING (meeting_id, t_ms) LEFT JOIN b USING (meeting_id, t_ms)"""
)
def asof_speaker(spark, sf):
    """Lines drawn out by 9 s, so that they overlap; asked every 7 s of every meeting."""
    lines = model.lines(spark, sf).withColumn("end_ms", F.col("end_ms") + 9000)
    stop = lines.groupBy("meeting_id").agg((F.max("end_ms") + 6999).alias("stop"))
    return intervals.speaker_at(stop.select("meeting_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("stop"), F.lit(7000).cast("bigint"))).alias("t_ms")), lines)


def _words(spark, sf):
    w = F.posexplode(F.regexp_extract_all("text", F.lit("[^ \n]+"), F.lit(0))).alias("i", "word")
    return model.lines(spark, sf).select("meeting_id", "position", F.col("start_ms").alias("line_ms"), w).select("meeting_id", (F.col("position") * 1000 + F.col("i")).alias("word_no"), (F.col("line_ms") + 400 * F.col("i")).alias("start_ms"), (F.col("line_ms") + 400 * F.col("i") + 400).alias("end_ms"))


def _grid(spark, sf, width=10_000):
    m = model.lines(spark, sf).groupBy("meeting_id").agg(F.max("end_ms").alias("stop"))
    return m.select("meeting_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("stop") / width).cast("int"))).alias("win")).select("meeting_id", "win", (F.col("win") * width).cast("bigint").alias("w_start"), ((F.col("win") + 1) * width - 3000).cast("bigint").alias("w_end"))


GRID = f"{L}, grid AS (SELECT meeting_id, win, win * 10000 AS w_start, (win + 1) * 10000 - 3000 AS w_end FROM (SELECT meeting_id, unnest(range(0, max(end_ms) // 10000 + 1)) AS win FROM lines GROUP BY 1))"


@query(f"WITH {GRID}, x AS (SELECT meeting_id, position, start_ms, unnest(range(0, len(regexp_extract_all(text, '[^ \\n]+')))) AS i FROM lines) SELECT x.meeting_id, (position * 1000 + i)::BIGINT AS word_no, win::BIGINT AS win FROM x JOIN grid g ON x.meeting_id = g.meeting_id AND start_ms + 400 * i + 200 >= w_start AND start_ms + 400 * i + 200 < w_end")
def word_attribution(spark, sf):
    return intervals.word_owner(_words(spark, sf), _grid(spark, sf)).select("meeting_id", F.col("word_no").cast("bigint").alias("word_no"), F.col("win").cast("bigint").alias("win"))


@query(f"WITH {GRID}, j AS (SELECT g.meeting_id, win, position, end_ms > w_start AND start_ms < w_end AS hit FROM grid g JOIN lines l USING (meeting_id)) SELECT meeting_id, win::BIGINT AS win, position FROM (SELECT *, bool_or(hit) OVER (PARTITION BY meeting_id, win) AS any_hit FROM j) WHERE hit OR NOT any_hit")
def segment_overlap(spark, sf):
    return intervals.overlapping(model.lines(spark, sf), _grid(spark, sf)).select("meeting_id", F.col("win").cast("bigint").alias("win"), "position")


@query(f"WITH {L} SELECT meeting_id, position FROM lines WHERE start_ms >= 20000 AND end_ms <= 90000")
def interval_contained(spark, sf):
    return intervals.contained(model.lines(spark, sf), 20_000, 90_000).select("meeting_id", "position")


# ---------------------------------------------------------------- vectors

MEANS = f"{VO}, p AS (SELECT label, i, avg(embedding[i]) AS x FROM voices, range(1, 65) r(i) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS v FROM p GROUP BY 1), profiles AS (SELECT 'voice-' || label AS name, v AS centroid FROM c)"


def _profiles(spark, sf):
    return vectors.centroids(model.voices(spark, sf), ["label"]).select(F.concat(F.lit("voice-"), F.col("label")).alias("name"), "centroid", "samples")


@query(f"WITH {MEANS}, s AS (SELECT 'voice-' || label AS name, count(*) AS samples FROM voices GROUP BY 1), n AS (SELECT name, centroid, sqrt(list_sum(list_transform(centroid, lambda x: x * x))) AS len FROM profiles) SELECT name, samples, unnest(range(64)) AS axis, round(unnest(centroid) / len, 5) AS value FROM n JOIN s USING (name)")
def cluster_centroids(spark, sf):
    d = _profiles(spark, sf).select("name", "samples", F.posexplode("centroid").alias("axis", "value"))
    return d.select("name", "samples", F.col("axis").cast("bigint").alias("axis"), F.round("value", 5).alias("value"))


RANKED = f"{MEANS}, ranked AS (SELECT vec_id, name, round(list_cosine_similarity(embedding, centroid), 6) AS score FROM voices, profiles)"


@query(f"WITH {RANKED}, t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, name) AS r, lead(score) OVER (PARTITION BY vec_id ORDER BY score DESC, name) AS second FROM ranked) SELECT vec_id, CASE WHEN score < 0.72 OR (second >= 0.72 AND score - second < 0.03) THEN 'Unknown' ELSE name END AS name, round(score, 3) AS score FROM t WHERE r = 1")
def voice_match(spark, sf):
    return vectors.match_profiles(model.voices(spark, sf), _profiles(spark, sf))


def _recordings(spark, sf, size=25):
    """Vectors dealt to small recordings."""
    v = model.voices(spark, sf)
    return v.select(F.floor(F.col("vec_id") / size).alias("meeting_id"), F.pmod("vec_id", F.lit(size)).cast("int").alias("position"), "vec_id", "label", "embedding")


PAIRS = f"{VO}, r AS (SELECT vec_id // 25 AS meeting_id, (vec_id % 25)::INT AS position, label, embedding FROM voices), pairs AS (SELECT a.meeting_id, a.position AS i, b.position AS j, a.label AS li, b.label AS lj, 1 - list_cosine_similarity(a.embedding, b.embedding) AS d FROM r a JOIN r b ON a.meeting_id = b.meeting_id AND a.position < b.position)"


@query(f"WITH {PAIRS} SELECT meeting_id, round(avg(d) FILTER (li = lj), 6) AS within, round(avg(d) FILTER (li <> lj), 6) AS across, count(*) FILTER (li = lj) AS same_pairs, count(*) FILTER (li <> lj) AS cross_pairs FROM pairs GROUP BY 1")
def pairwise_separation(spark, sf):
    d = vectors.separation(vectors.pairs_within(_recordings(spark, sf), "meeting_id", "position"), "meeting_id")
    return d.select("meeting_id", F.round("within", 6).alias("within"), F.round("across", 6).alias("across"), "same_pairs", "cross_pairs")


@query(f"WITH {PAIRS} SELECT meeting_id, round(quantile_cont(d, 0.9), 6) AS p90, round(max(d), 6) AS most, count(*) < 3 OR (max(d) < 0.42 AND quantile_cont(d, 0.9) < 0.38) AS single FROM pairs GROUP BY 1")
def single_speaker_p90(spark, sf):
    d = vectors.single_speaker(vectors.pairs_within(_recordings(spark, sf), "meeting_id", "position"), "meeting_id")
    return d.select("meeting_id", F.round("p90", 6).alias("p90"), F.round("most", 6).alias("most"), "single")


@query(
    f"""WITH {VO}, r AS (SELECT vec_id // 25 AS meeting_id, (vec_id % 25)::INT AS position, embedding FROM voices),
d AS (SELECT meeting_id, position AS i, 1 - list_cosine_similarity(embedding, lag(embedding) OVER (PARTITION BY meeting_id ORDER BY position)) AS d FROM r QUALIFY lag(embedding) OVER (PARTITION BY meeting_id ORDER BY position) IS NOT NULL),
m AS (SELECT meeting_id, median(d) AS med, count(*) AS n FROM d GROUP BY 1), a AS (SELECT meeting_id, median(abs(d - med)) AS mad FROM d JOIN m USING (meeting_id) GROUP BY 1),
t AS (SELECT meeting_id, CASE WHEN n < 3 THEN 0.13 ELSE least(greatest(med + greatest(1.5 * mad, 0.05), 0.13), 0.35) END AS threshold FROM m JOIN a USING (meeting_id)),
p AS (SELECT *, max(d) OVER (PARTITION BY meeting_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS peak FROM d JOIN t USING (meeting_id))
SELECT meeting_id, i, round(d, 6) AS d, round(threshold, 6) AS threshold FROM p WHERE d >= threshold AND d = peak"""
)
def change_points(spark, sf):
    d = intervals.change_points(intervals.consecutive_distances(_recordings(spark, sf), "meeting_id", "position"), "meeting_id")
    return d.withColumn("d", F.round("d", 6))


def _segments(spark, sf):
    return _recordings(spark, sf).select("meeting_id", "position", (F.col("position") * 2.5).alias("start_sec"), (F.col("position") * 2.5 + 2).alias("end_sec"), "embedding", F.concat(F.lit("Speaker_0"), F.pmod("label", F.lit(4))).alias("speaker_label"))


@query()
def online_clusters(spark, sf):
    return clustering.online_labels(_segments(spark, sf))


@query()
def offline_recluster(spark, sf):
    return clustering.offline_labels(_segments(spark, sf))


@query()
def threshold_sweep(spark, sf):
    return clustering.distance_sweep(_segments(spark, sf), [0.4, 0.5, 0.6, 0.7, 0.8])


@query(
    f"""WITH {VO}, r AS (SELECT vec_id // 25 AS g, label AS x, label % 4 AS y FROM voices), t AS (SELECT g, x, y, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT g, sum(n * (n - 1) / 2) AS joint, sum(n) AS total FROM t GROUP BY 1), rs AS (SELECT g, sum(n * (n - 1) / 2) AS rows_ FROM (SELECT g, x, sum(n) AS n FROM t GROUP BY 1, 2) GROUP BY 1),
cs AS (SELECT g, sum(n * (n - 1) / 2) AS cols FROM (SELECT g, y, sum(n) AS n FROM t GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT g, joint, rows_ * cols / (total * (total - 1) / 2) AS ex, (rows_ + cols) / 2 AS mx FROM b JOIN rs USING (g) JOIN cs USING (g))
SELECT g AS meeting_id, round(CASE WHEN mx = ex THEN 1.0 ELSE (joint - ex) / (mx - ex) END, 6) AS ari FROM e"""
)
def rand_index(spark, sf):
    r = _recordings(spark, sf)
    t = vectors.contingency(r, r.withColumn("label", F.pmod("label", F.lit(4))), ["meeting_id", "position"])
    return vectors.adjusted_rand(t, "meeting_id").withColumn("ari", F.round("ari", 6))


@query(f"WITH {VO}, r AS (SELECT vec_id // 25 AS g, label AS x, label % 4 AS y FROM voices), t AS (SELECT DISTINCT g, x, y FROM r) SELECT g AS meeting_id, count(*) = count(DISTINCT x) AND count(*) = count(DISTINCT y) AS equivalent FROM t GROUP BY 1")
def partition_equivalence(spark, sf):
    r = _recordings(spark, sf)
    return vectors.same_partition(vectors.contingency(r, r.withColumn("label", F.pmod("label", F.lit(4))), ["meeting_id", "position"]), "meeting_id")


@query(f"WITH {VO}, r AS (SELECT DISTINCT vec_id // 25 AS g, label % 4 AS o, label AS s FROM voices) SELECT DISTINCT a.g AS meeting_id, a.s AS a, b.s AS b FROM r a JOIN r b ON a.g = b.g AND a.o = b.o AND a.s < b.s")
def co_membership(spark, sf):
    r = _recordings(spark, sf)
    return vectors.co_membership(r.withColumn("label", F.pmod("label", F.lit(4))), r, ["meeting_id", "position"])


# ---------------------------------------------------------------- insights


@query(
    f"""WITH {L}, q AS (SELECT meeting_id, position AS item, text AS quote FROM lines),
t AS (SELECT q.meeting_id, item, position, list_distinct(regexp_extract_all(lower(quote), '[a-z{X.DEVANAGARI_WORD}]{{3,}}')) AS a, list_distinct(regexp_extract_all(lower(text), '[a-z{X.DEVANAGARI_WORD}]{{3,}}')) AS b FROM q JOIN lines USING (meeting_id))
SELECT meeting_id, item, position, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, b)) / len(a), 6) ELSE 0 END::DOUBLE AS overlap FROM t"""
)
def quote_overlap(spark, sf):
    lines = model.lines(spark, sf)
    q = lines.select("meeting_id", F.col("position").alias("item"), F.col("text").alias("quote"))
    d = q.join(lines.select("meeting_id", "position", "text"), "meeting_id")
    return d.select("meeting_id", "item", "position", F.round(insights.overlap_ratio(F.col("quote"), F.col("text")), 6).alias("overlap"))


@query(f"WITH {L} SELECT meeting_id, position, speaker FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, lower(speaker) ORDER BY position) AS r FROM lines) WHERE r = 1")
def dedup_first(spark, sf):
    return insights.first_by_key(model.lines(spark, sf), F.lower("speaker"), "position").select("meeting_id", "position", "speaker")


def _quotes(lines):
    """Three quotes of every line: as said, with every third word altered, and as if said in the next meeting."""
    altered = F.array_join(F.transform(F.split("text", " "), lambda w, i: F.when(i % 3 == 1, F.concat(w, F.lit("x"))).otherwise(w)), " ")
    kinds = [("meeting_id", F.col("text")), ("meeting_id", altered), (F.col("meeting_id") + 1, F.col("text"))]
    three = F.explode(F.array(*[F.struct((F.col(m) if isinstance(m, str) else m).alias("meeting_id"), (F.col("position") * 3 + k).alias("item"), q.alias("quote")) for k, (m, q) in enumerate(kinds)]))
    return lines.select(three.alias("q")).select("q.*")


@query()
def quotes_verified(spark, sf):
    lines = model.lines(spark, sf)
    return quotes.quote_matches(_quotes(lines), lines)


#: The same three quotes of every line, and what normalise() makes of quotes and lines.
QUOTES = rf"""{L}, altered AS (SELECT *, array_to_string(list_transform(string_split(text, ' '), lambda w, i: CASE WHEN i % 3 = 2 THEN w || 'x' ELSE w END), ' ') AS other FROM lines),
quotes AS (SELECT meeting_id, position * 3 AS item, text AS quote FROM altered UNION ALL SELECT meeting_id, position * 3 + 1, other FROM altered UNION ALL SELECT meeting_id + 1, position * 3 + 2, text FROM altered)"""


def _normal(c: str) -> str:
    return rf"regexp_replace(trim(lower(coalesce({c}, '')), '{X.STRIP.replace("'", "''")}'), '\s+', ' ', 'g')"


@query(
    f"""WITH {QUOTES}, n AS (SELECT meeting_id, item, {_normal("quote")} AS needle FROM quotes), h AS (SELECT meeting_id, position, {_normal("text")} AS hay FROM lines),
f AS (SELECT meeting_id, item, min(position) AS position FROM n JOIN h USING (meeting_id) WHERE needle <> '' AND hay <> '' AND (contains(hay, needle) OR contains(needle, hay)) GROUP BY ALL)
SELECT meeting_id, item, position FROM f"""
)
def quotes_contained(spark, sf):
    lines = model.lines(spark, sf)
    return quotes.contained_quotes(_quotes(lines), lines).filter("position IS NOT NULL").drop("quote")


@query(
    f"""WITH {QUOTES}, a AS (SELECT meeting_id, item, list_distinct(regexp_extract_all(lower(quote), '[a-z{X.DEVANAGARI_WORD}]{{3,}}')) AS a FROM quotes),
b AS (SELECT meeting_id, list_distinct(regexp_extract_all(lower(text), '[a-z{X.DEVANAGARI_WORD}]{{3,}}')) AS b FROM lines),
f AS (SELECT DISTINCT meeting_id, item FROM a JOIN b USING (meeting_id) WHERE len(a) >= 2 AND len(list_intersect(a, b)) / len(a) >= 0.65)
SELECT q.meeting_id, q.item, f.item IS NOT NULL AS shared FROM quotes q LEFT JOIN f ON q.meeting_id = f.meeting_id AND q.item = f.item"""
)
def quotes_shared(spark, sf):
    lines = model.lines(spark, sf)
    return quotes.shared_quotes(_quotes(lines), lines).drop("quote")


def _tasks(spark, sf):
    m = model.meetings(spark, sf)
    empty = lambda kind: F.array().cast(kind)
    title = F.concat(F.lit("Review "), F.col("department"))
    items = F.array(F.struct(title.alias("title"), F.when(F.col("owner_id") % 2 == 0, F.lit("Asha")).alias("assignee"), F.lit(None).cast("string").alias("due")))
    pend = F.array(F.struct(F.lit("Plan").alias("topic"), F.when(F.col("id") % 3 == 0, title).otherwise("Call back").alias("description"), F.lit("Ravi").alias("owner")))
    return m.select("id", items.alias("action_items"), pend.alias("pending"), empty("array<struct<action:string,owner:string,timing:string>>").alias("commitments"), empty("array<struct<detail:string,deadline:string>>").alias("deadlines"))


@query(
    f"""WITH {M}, a AS (SELECT id, 'Review ' || department AS t, CASE WHEN owner_id % 2 = 0 THEN 'Asha' ELSE 'Unassigned' END AS who FROM meetings)
SELECT id, 'action_items' AS source, t AS title, who AS assignee FROM a WHERE t IS NOT NULL
UNION ALL SELECT id, 'pending', CASE WHEN id % 3 = 0 THEN coalesce(t, 'Plan') ELSE 'Call back' END, 'Ravi' FROM a WHERE id % 3 <> 0 OR t IS NULL"""
)
def task_flatten(spark, sf):
    return D.flatten_tasks(_tasks(spark, sf)).select("id", "source", "title", "assignee")


# ---------------------------------------------------------------- sessions


@query(
    """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events, round(sum(value), 6) AS total FROM s GROUP BY user_id, n"""
)
def session_events(spark, sf):
    from parley.streaming.live import sessions

    return _ntz(sessions(model.table(spark, sf, "events"), "user_id", "ts"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def tumbling_events(spark, sf):
    from parley.streaming.live import tumbling

    return _ntz(tumbling(model.table(spark, sf, "events"), "ts"))


def _ntz(df: DataFrame) -> DataFrame:
    """Instants as wall-clock times in UTC, the type that the tables have."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, k in df.dtypes if k == "timestamp"})


from parley.plans import catalog_flow, catalog_meetings, catalog_text, catalog_voices  # noqa: E402, F401  they register their queries here
