"""The same model as DuckDB CTEs, for the SQL that checks the queries."""

from parley.sources.model import SAYINGS

LINES = """w AS (SELECT conv_id AS meeting_id, turn::INT AS position, role, text, len(regexp_extract_all(coalesce(text, ''), '[^ \\n]+'))::BIGINT AS n, ((conv_id + turn // 2) % 3)::INT AS k FROM conversations),
d AS (SELECT *, 400 * n AS dur_ms, 1000 * ((7 * meeting_id + 13 * position) % 5) AS gap_ms FROM w),
s AS (SELECT *, coalesce(sum(dur_ms + gap_ms) OVER (PARTITION BY meeting_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM d),
lines AS (SELECT meeting_id, position, start_ms, (start_ms + dur_ms)::BIGINT AS end_ms, 'Speaker_0' || k AS speaker_label,
  CASE WHEN (meeting_id + position) % 11 = 0 THEN 'Asha + Ravi' WHEN k = 0 THEN 'Asha' WHEN k = 1 THEN 'Ravi' ELSE 'Speaker_02' END AS speaker,
  (3 * meeting_id + position) % 7 = 0 AS is_overlap, CASE WHEN (3 * meeting_id + position) % 7 = 0 THEN ['Asha', 'Ravi'] END AS candidate_speakers,
  CASE role WHEN 'user' THEN 'en' WHEN 'assistant' THEN 'hi' END AS language, 'speaker-' || ((meeting_id + k) % 10 + 1) AS color, role, text FROM s)"""

MEETINGS = """meetings AS (SELECT event_id AS id, ts AS uploaded_at, value AS duration_seconds, 'Sync ' || user_id AS title, props AS agenda,
  CASE event_id % 10 WHEN 0 THEN 'Processing' WHEN 1 THEN 'Failed' ELSE 'Completed' END AS status,
  CASE WHEN event_type = 'purchase' THEN 'client' WHEN event_type <> 'error' THEN 'internal' END AS meeting_type,
  CASE WHEN event_type <> 'view' THEN event_type END AS department, user_id AS owner_id,
  CASE WHEN event_id % 17 = 0 THEN ts + INTERVAL 1 DAY END AS deleted_at FROM events)"""

VOICES = "voices AS (SELECT vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings)"

#: Merged turns (W1) by walking each meeting's lines in order.
TURNS = (
    LINES.replace("w AS (", "RECURSIVE w AS (", 1)
    + """,
walk AS (SELECT meeting_id, position, start_ms, end_ms, speaker_label, 0 AS turn, start_ms AS turn_start FROM lines WHERE position = 0
  UNION ALL
  SELECT l.meeting_id, l.position, l.start_ms, l.end_ms, l.speaker_label,
    CASE WHEN l.speaker_label = w.speaker_label AND l.start_ms - w.end_ms <= 2500 AND l.end_ms - w.turn_start <= 120000 THEN w.turn ELSE w.turn + 1 END,
    CASE WHEN l.speaker_label = w.speaker_label AND l.start_ms - w.end_ms <= 2500 AND l.end_ms - w.turn_start <= 120000 THEN w.turn_start ELSE l.start_ms END
  FROM walk w JOIN lines l ON l.meeting_id = w.meeting_id AND l.position = w.position + 1),
turns AS (SELECT w.meeting_id, turn, any_value(w.speaker_label) AS speaker_label, arg_min(l.speaker, l.position) AS speaker, min(w.start_ms)::BIGINT AS start_ms, arg_max(w.end_ms, w.position)::BIGINT AS end_ms, count(*)::INT AS segments
  FROM walk w JOIN lines l USING (meeting_id, position) GROUP BY w.meeting_id, turn)"""
)


def _literal(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


#: lines of which most say one of the model's SAYINGS.
SAID = LINES + f""",
said AS (SELECT * REPLACE (CASE WHEN (3 * meeting_id + position) % {len(SAYINGS) + 3} < {len(SAYINGS)} THEN {_literal(SAYINGS)}[((3 * meeting_id + position) % {len(SAYINGS) + 3} + 1)::INT] ELSE text END AS text) FROM lines)"""
