"""Registered queries over text and number functions, each beside the DuckDB SQL that checks it where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import scalar as S
from parley.functions import text as X
from parley.functions import vocabulary as V
from parley.operators import insights, signal, turns
from parley.plans.catalog import query, quoted
from parley.sources import duck, model

SAID, M, VO = duck.SAID, duck.MEETINGS, duck.VOICES
DEVA, WORD = "ऀ-ॿ", X.DEVANAGARI_WORD


def said(spark, sf):
    return model.sayings(spark, sf)


def words_in(vocabulary: list[str]) -> str:
    return f"[{quoted(vocabulary)}]"


def count_letters(text: str, kind: str) -> str:
    return f"length(regexp_replace(coalesce({text}, ''), '[^{kind}]', '', 'g'))"


# ---------------------------------------------------------------- names and cues


def _name(raw: str) -> str:
    """person_name in SQL."""
    return f"""(SELECT CASE WHEN length(n) < 2 OR lower(n) IN ({quoted(V.NOT_NAMES)}) THEN NULL WHEN regexp_matches(n, '[A-Za-z]')
  THEN array_to_string(list_transform(regexp_extract_all(lower(n), '[\\p{{L}}]+|[^\\p{{L}}]+'), lambda x: upper(x[1]) || x[2:]), '') ELSE n END FROM (SELECT trim({raw}, ' .,!?;:''"') AS n))"""


def _first_name(patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(_name(f"""regexp_extract(text, '{p.replace("'", "''")}', 1)""") for p in patterns) + ")"


@query(f"WITH {SAID} SELECT meeting_id, position, {_first_name(V.INTRODUCTIONS)} AS name FROM said")
def introduced_names(spark, sf):
    return said(spark, sf).select("meeting_id", "position", X.introduced_name(F.col("text")).alias("name"))


@query(f"WITH {SAID} SELECT meeting_id, position, {_first_name(V.GREETINGS)} AS name FROM said")
def greeted_names(spark, sf):
    return said(spark, sf).select("meeting_id", "position", X.greeted_name(F.col("text")).alias("name"))


@query(f"WITH {SAID} SELECT meeting_id, position, (end_ms - start_ms) < 1800 AND rtrim(lower(trim(text)), '.!?,') IN ({quoted(V.SHORT_FILLERS)}) AS filler FROM said")
def short_fillers(spark, sf):
    return said(spark, sf).select("meeting_id", "position", X.is_short_filler(F.col("text"), (F.col("end_ms") - F.col("start_ms")) / 1000).alias("filler"))


@query(f"WITH {SAID} SELECT meeting_id, position FROM said WHERE regexp_matches(trim(text), '(?i)^\\s*\\(?\\[?\\s*({'|'.join(V.SOUNDS)})\\.?\\s*\\]?\\)?\\s*$')")
def noise_lines(spark, sf):
    return said(spark, sf).filter(X.is_noise(F.col("text"))).select("meeting_id", "position")


def _cue(phrases: list[str], text: str = "text") -> str:
    return f"len(list_filter({words_in(phrases)}, lambda p: contains(lower({text}), p))) > 0"


@query(f"WITH {SAID} SELECT meeting_id, position, {_cue(V.DECISION_CUES)} AS decides, {_cue(V.ACTION_CUES)} AS acts FROM said")
def cue_lines(spark, sf):
    return said(spark, sf).select("meeting_id", "position", X.cue(F.col("text"), V.DECISION_CUES).alias("decides"), X.cue(F.col("text"), V.ACTION_CUES).alias("acts"))


LOW = "trim(lower(trim(text)), ' .,!?')"


@query(
    f"""WITH {SAID} SELECT meeting_id, position,
  trim(text) <> '' AND NOT ({_cue(V.HYPOTHETICAL, LOW)} OR {LOW} IN ({quoted(V.FILLER_DECISIONS)})) AND NOT (len(regexp_split_to_array(trim(text), '\\s+')) < 2 AND NOT ({_cue(V.SHORT_DECISIONS, LOW)})) AS decision,
  trim(text) <> '' AND NOT ends_with(trim(text), '?') AND {LOW} NOT IN ({quoted(V.NO_ACTIONS)}) AND NOT ({" OR ".join(f"starts_with({LOW}, '{p}')" for p in V.NO_ACTION_STARTS)}) AS action FROM said"""
)
def item_filters(spark, sf):
    return said(spark, sf).select("meeting_id", "position", insights.is_decision(F.col("text")).alias("decision"), insights.is_action(F.col("text")).alias("action"))


@query(
    f"""WITH {SAID}, p AS (SELECT meeting_id, list(DISTINCT speaker) AS names, string_agg(text, ' ' ORDER BY position) AS spoken FROM said GROUP BY 1), o AS (SELECT meeting_id, unnest(['RAVI', 'asha + ravi', 'ship', 'up', 'Unassigned', 'nobody here']) AS owner FROM p)
SELECT o.meeting_id, owner, CASE WHEN lower(owner) IN ({quoted(V.NO_OWNER)}) THEN NULL WHEN len(list_filter(names, lambda n: lower(n) = lower(owner))) > 0 THEN owner WHEN length(owner) >= 3 AND contains(lower(spoken), lower(owner)) THEN owner END AS assignee FROM o JOIN p USING (meeting_id)"""
)
def verified_assignees(spark, sf):
    d = said(spark, sf).groupBy("meeting_id").agg(F.collect_set("speaker").alias("names"), F.array_sort(F.collect_list(F.struct("position", "text"))).alias("xs"))
    d = d.withColumn("spoken", F.array_join(F.transform("xs", lambda x: x["text"]), " "))
    d = d.withColumn("owner", F.explode(F.array(*[F.lit(x) for x in ("RAVI", "asha + ravi", "ship", "up", "Unassigned", "nobody here")])))
    return d.select("meeting_id", "owner", insights.verify_assignee(F.col("owner"), F.col("names"), F.col("spoken")).alias("assignee"))


# ---------------------------------------------------------------- language and script


HITS = lambda text, deva, latin: f"len(list_filter(ws, lambda w: list_contains(CASE WHEN deva THEN {words_in(deva)} ELSE {words_in(latin)} END, w)))"
BREAK = V.WORD_BREAK.replace("'", "''")
GUESS = f"""{SAID}, ws AS (SELECT *, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{BREAK}'), lambda w: w <> '') AS ws, regexp_matches(coalesce(text, ''), '[{DEVA}]') AS deva FROM said),
sc AS (SELECT *, {HITS("text", V.MARATHI, V.MARATHI_ROMAN)} AS mr, {HITS("text", V.HINDI, V.HINDI_ROMAN)} AS hi FROM ws),
guess AS (SELECT *, CASE WHEN len(ws) = 0 THEN NULL WHEN mr + hi = 0 AND NOT deva THEN 'en' WHEN mr + hi = 0 OR mr = hi THEN NULL WHEN mr > hi THEN 'mr' ELSE 'hi' END AS guess,
  CASE WHEN len(ws) > 0 AND mr + hi > 0 THEN abs(mr - hi) / (mr + hi) ELSE 0 END::DOUBLE AS confidence FROM sc)"""


@query(f"WITH {GUESS} SELECT meeting_id, position, guess, confidence FROM guess")
def lexical_language(spark, sf):
    g = X.lexical_language(F.col("text"))
    return said(spark, sf).select("meeting_id", "position", g["language"].alias("guess"), g["confidence"].alias("confidence"))


@query(f"WITH {GUESS} SELECT meeting_id, position, CASE WHEN guess IN ('hi', 'mr') AND confidence >= 0.34 AND guess IS DISTINCT FROM language THEN guess ELSE language END AS language FROM guess")
def language_overrides(spark, sf):
    return said(spark, sf).select("meeting_id", "position", X.language_override(F.col("language"), F.col("text")).alias("language"))


LETTERS = "length(regexp_replace(text, '[^\\p{L}]', '', 'g'))"
DEVA_LETTERS = f"length(regexp_replace(regexp_replace(text, '[^\\p{{L}}]', '', 'g'), '[^{DEVA}]', '', 'g'))"


def _mismatch(code: str) -> str:
    return f"({code} IN ('hi', 'mr') AND ({LETTERS} = 0 OR {DEVA_LETTERS} / greatest({LETTERS}, 1) < 0.35))"


@query(f"WITH {SAID} SELECT meeting_id, position, {_mismatch('language')} AS mismatch, CASE WHEN NOT coalesce({_mismatch('language')}, true) THEN text ELSE '' END AS kept FROM said")
def script_checks(spark, sf):
    """Script mismatch, and what is left of a text whose other decode is missing."""
    none = F.lit(None).cast("string")
    return said(spark, sf).select("meeting_id", "position", X.script_mismatch(F.col("language"), F.col("text")).alias("mismatch"), X.script_retry(F.col("language"), F.col("text"), none).alias("kept"))


@query(f"WITH {GUESS} SELECT meeting_id, position, CASE WHEN language = 'en' AND guess IN ('hi', 'mr') AND confidence >= 0.34 THEN array_to_string([guess, CASE WHEN guess = 'hi' THEN 'mr' ELSE 'hi' END], ',') ELSE '' END AS candidates FROM guess")
def recovery_candidates(spark, sf):
    c = X.recovery_candidates(F.col("language"), F.col("text"), F.lit(None).cast("string"))
    return said(spark, sf).select("meeting_id", "position", F.array_join(c, ",").alias("candidates"))


@query(f"""WITH {SAID}, b AS (SELECT meeting_id, position, text, {count_letters("text", DEVA)} AS dev, {count_letters("text", "A-Za-z")} AS lat, language FROM said)
SELECT meeting_id, position, CASE WHEN dev > lat AND (len(list_filter({words_in(V.MARATHI_MARKERS)}, lambda m: contains(text, m))) > 0 OR language IN ('mr', 'mr-in')) THEN 'mr' WHEN dev > lat THEN 'hi' WHEN lat > 0 THEN 'en' END AS bucket FROM b""")
def script_buckets(spark, sf):
    return said(spark, sf).select("meeting_id", "position", X.script_bucket(F.col("language"), F.col("text")).alias("bucket"))


@query(f"""WITH {SAID}, b AS (SELECT meeting_id, position, language, {count_letters("text", DEVA)} > 0 AND {count_letters("text", "A-Za-z")} > 0 AS twice FROM said), h AS (SELECT *, CASE WHEN language IS NULL THEN [] ELSE [language] END AS heard FROM b),
m AS (SELECT *, CASE WHEN twice THEN list_concat(heard, list_filter(['en', CASE WHEN language IN ('hi', 'mr') THEN language ELSE 'mr' END], lambda x: NOT list_contains(heard, x))) ELSE heard END AS mix FROM h)
SELECT meeting_id, position, CASE WHEN len(mix) > 1 THEN array_to_string(mix, ',') END AS mix FROM m""")
def language_mixes(spark, sf):
    heard = F.filter(F.array("language"), lambda x: x.isNotNull())
    return said(spark, sf).select("meeting_id", "position", F.array_join(X.language_mix(heard, F.col("text"), F.col("language")), ",").alias("mix"))


@query(f"""WITH {SAID}, c AS (SELECT *, ['hi-IN', 'ta-IN', 'en', ''][(position % 4 + 1)::INT] AS code FROM said), tw AS (SELECT *, lower(split_part(code, '-', 1)) AS two FROM c), b AS (SELECT *, CASE WHEN two IN ('en', 'hi', 'mr') THEN two ELSE coalesce(language, 'en') END AS base FROM tw)
SELECT meeting_id, position, CASE WHEN regexp_matches(text, '[{DEVA}]') AND base NOT IN ('hi', 'mr') THEN 'mr' ELSE base END AS language, two NOT IN ('en', 'hi', 'mr') AS fallback FROM b""")
def cloud_languages(spark, sf):
    code = F.element_at(F.array(*[F.lit(x) for x in ("hi-IN", "ta-IN", "en", "")]), F.pmod("position", F.lit(4)).cast("int") + 1)
    return said(spark, sf).select("meeting_id", "position", X.cloud_language(code, F.col("language"), F.col("text")).alias("c")).select("meeting_id", "position", "c.*")


@query(f"""WITH {SAID}, o AS (SELECT *, CASE WHEN position % 3 = 0 THEN 'kn' ELSE language END AS code FROM said), c AS (SELECT *, count(*) FILTER (code = 'en') OVER w AS en, count(*) FILTER (code = 'hi') OVER w AS hi,
  min(position) FILTER (code = 'en') OVER w AS pe, min(position) FILTER (code = 'hi') OVER w AS ph FROM o WINDOW w AS (PARTITION BY meeting_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT meeting_id, position, CASE WHEN code IN ('en', 'hi', 'mr') THEN code WHEN hi > en OR (hi = en AND hi > 0 AND ph < pe) THEN 'hi' ELSE 'en' END AS language, NOT coalesce(code IN ('en', 'hi', 'mr'), false) AS language_fallback FROM c""")
def language_fallbacks(spark, sf):
    odd = F.when(F.pmod("position", F.lit(3)) == 0, "kn").otherwise(F.col("language"))
    return turns.language_fallback(said(spark, sf).withColumn("language", odd)).select("meeting_id", "position", "language", "language_fallback")


@query("SELECT 'mr' AS code WHERE NOT EXISTS (SELECT 1 FROM conversations WHERE role = 'tool')")
def missing_languages(spark, sf):
    return turns.missing_languages(model.lines(spark, sf).filter("language IS NOT NULL").select(F.col("language").alias("code")))


# ---------------------------------------------------------------- titles, lists, labels

FILE = "title || '_final-Cut spk' || (id % 7) || CASE id % 3 WHEN 0 THEN '.MP3' WHEN 1 THEN '.txt' ELSE '' END"


def _file():
    tail = F.when(F.pmod("id", F.lit(3)) == 0, ".MP3").when(F.pmod("id", F.lit(3)) == 1, ".txt").otherwise("")
    return F.concat("title", F.lit("_final-Cut spk"), F.pmod("id", F.lit(7)).cast("string"), tail)


@query(f"""WITH {M}, f AS (SELECT id, {FILE} AS f FROM meetings), s AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(f, '\\.[^.]*$', ''), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS stem FROM f)
SELECT id, array_to_string(list_transform(string_split(stem, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title, lower(regexp_extract(f, '\\.([^.]+)$', 1)) AS extension, nullif(regexp_extract(lower(f), 'spk[-_\\s]?(\\d+)', 1), '')::INT AS speakers FROM s""")
def file_titles(spark, sf):
    return model.meetings(spark, sf).select("id", X.title_from_file(_file()).alias("title"), X.extension(_file()).alias("extension"), X.expected_speakers(_file()).alias("speakers"))


@query(f"""WITH {M}, f AS (SELECT id, {FILE} AS f, (duration_seconds * 10000000)::BIGINT * (id % 4) AS size FROM meetings)
SELECT id, array_to_string(list_filter([CASE WHEN lower(regexp_extract(f, '\\.([^.]+)$', 1)) NOT IN ({quoted(V.UPLOAD_TYPES)}) THEN 'type not allowed' END, CASE WHEN size > 300 * 1048576 THEN 'too large' END, CASE WHEN coalesce(size, 0) = 0 THEN 'empty' END], lambda x: x IS NOT NULL), '; ') AS problems FROM f""")
def upload_checks(spark, sf):
    size = F.round(F.col("duration_seconds") * 10_000_000).cast("bigint") * F.pmod("id", F.lit(4))
    return model.meetings(spark, sf).select("id", F.array_join(X.upload_problems(_file(), size), "; ").alias("problems"))


@query(f"""WITH {SAID}, t AS (SELECT meeting_id, position, trim(regexp_replace(trim(text), '(?i)^(?:(?:{"|".join(V.FILLERS)})[,\\s.\\-]+)+', '')) AS t FROM said), u AS (SELECT meeting_id, position, regexp_replace(t, '^[^a-zA-Z{DEVA}]+', '') AS t FROM t),
sn AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '[.!?]+'), lambda x: trim(x)), lambda x: x <> '') AS ss FROM u), p AS (SELECT *, coalesce(list_filter(ss, lambda x: len(regexp_split_to_array(x, '\\s+')) >= 2)[1], ss[1], t) AS c FROM sn),
wd AS (SELECT *, regexp_split_to_array(c, '\\s+') AS w FROM p) SELECT meeting_id, position, trim(CASE WHEN len(w) > 5 THEN regexp_replace(array_to_string(w[1:5], ' '), '[.,;:\\-]+$', '') || '...' ELSE c END, ' .,;:-') AS title FROM wd""")
def short_titles(spark, sf):
    return said(spark, sf).select("meeting_id", "position", X.short_title(F.col("text"), 5).alias("title"))


@query(f"""WITH {SAID}, c AS (SELECT meeting_id, position, array_to_string(list_transform(string_split(speaker, ' + '), lambda x: ' ' || x || ' '), ',,') AS csv FROM said), l AS (SELECT *, list_filter(list_transform(string_split(csv, ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM c)
SELECT meeting_id, position, CASE WHEN len(l) >= 2 THEN len(l) ELSE 0 END::INT AS entries, CASE WHEN len(l) >= 2 THEN array_to_string(l, ',') END AS again FROM l""")
def csv_lists(spark, sf):
    csv = F.array_join(F.transform(F.split("speaker", r" \+ "), lambda x: F.concat(F.lit(" "), x, F.lit(" "))), ",,")
    items = X.csv_to_list(csv)
    return said(spark, sf).select("meeting_id", "position", F.when(items.isNotNull(), F.size(items)).otherwise(0).alias("entries"), X.list_to_csv(items).alias("again"))


@query(f"WITH {SAID} SELECT meeting_id, position, CASE WHEN position % 4 = 0 AND speaker <> '' THEN 'Unknown' WHEN position % 4 = 1 THEN 'Meera' END AS identified, CASE WHEN position % 4 = 1 THEN 'Meera' ELSE coalesce(nullif(CASE WHEN position % 4 = 2 THEN '' ELSE speaker END, ''), speaker_label) END AS shown FROM said")
def shown_names(spark, sf):
    k = F.pmod("position", F.lit(4))
    identified = F.when((k == 0) & (F.col("speaker") != ""), "Unknown").when(k == 1, "Meera")
    return said(spark, sf).select("meeting_id", "position", identified.alias("identified"), X.display_name(identified, F.when(k == 2, "").otherwise(F.col("speaker")), F.col("speaker_label")).alias("shown"))


@query(f"WITH {SAID} SELECT meeting_id, position, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS text FROM said")
def truncated_texts(spark, sf):
    return said(spark, sf).select("meeting_id", "position", X.truncate(F.col("text")).alias("text"))


@query(f"""WITH {SAID}, n AS (SELECT DISTINCT speaker FROM said), h AS (SELECT speaker, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(speaker) + 1), lambda i: unicode(speaker[i])::BIGINT)), lambda a, c: ((((a * 31 + c + 2147483648) % 4294967296) + 4294967296) % 4294967296) - 2147483648) AS h FROM n)
SELECT speaker, CASE WHEN regexp_matches(speaker, '(?i)^speaker[_\\s]?\\d+$') THEN regexp_extract(speaker, '(\\d+)$', 1)::BIGINT % 10 ELSE abs(h) % 10 END::INT AS slot FROM h""")
def palette_slots(spark, sf):
    return said(spark, sf).select("speaker").distinct().select("speaker", X.palette_index(F.col("speaker")).alias("slot"))


@query(f"WITH {SAID}, v AS (SELECT meeting_id, position, [text, ' None ', 'not specified', ''][(position % 4 + 1)::INT] AS v FROM said) SELECT meeting_id, position, CASE WHEN lower(trim(v)) IN ({quoted(V.NULLISH)}) THEN NULL ELSE trim(v) END AS value FROM v")
def nullish_values(spark, sf):
    v = F.element_at(F.array(F.col("text"), F.lit(" None "), F.lit("not specified"), F.lit("")), F.pmod("position", F.lit(4)).cast("int") + 1)
    return said(spark, sf).select("meeting_id", "position", X.nullish(v).alias("value"))


@query(f"WITH {M} SELECT id, 'db://user' || owner_id || ':***@host/' || id AS url FROM meetings")
def masked_urls(spark, sf):
    url = F.concat(F.lit("db://user"), "owner_id", F.lit(":p"), "id", F.lit("!x@host/"), "id")
    return model.meetings(spark, sf).select("id", X.mask_password(url).alias("url"))


@query(f"WITH {SAID} SELECT meeting_id, string_agg('[' || lpad((start_ms // 60000)::VARCHAR, 2, '0') || ':' || lpad((start_ms // 1000 % 60)::VARCHAR, 2, '0') || '] ' || speaker || ': ' || text, chr(10) ORDER BY position) AS content FROM said GROUP BY 1")
def window_texts(spark, sf):
    d = said(spark, sf).select("meeting_id", F.struct("position", S.time_label(F.col("start_ms") / 1000).alias("time"), "speaker", "text").alias("x"))
    return d.groupBy("meeting_id").agg(X.window_text("time", "speaker", "text", F.array_sort(F.collect_list("x"))).alias("content"))


@query(f"WITH {SAID}, sp AS (SELECT meeting_id, position // 3 AS part, string_agg(speaker || ': ' || text, ' / ' ORDER BY position) FILTER (trim(text) <> '') AS content FROM said GROUP BY 1, 2) SELECT meeting_id, part::BIGINT AS part, coalesce(content, '') AS content FROM sp")
def overlap_texts(spark, sf):
    d = said(spark, sf).groupBy("meeting_id", F.floor(F.col("position") / 3).alias("part")).agg(F.array_sort(F.collect_list(F.struct("position", "speaker", "text"))).alias("spans"))
    return d.select("meeting_id", "part", X.overlap_text(F.col("spans")).alias("content"))


@query(f"""WITH {SAID}, j AS (SELECT meeting_id, position, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS t FROM said) SELECT meeting_id, position, t AS plain, t AS object, t || ' ' || t AS listed FROM j""")
def summary_texts(spark, sf):
    """The summary in an answer that is a string, an object or a list."""
    t = F.regexp_replace("text", "[^A-Za-z ]", "")
    clean = lambda c: X.summary_text(c)
    d = said(spark, sf).select("meeting_id", "position", t.alias("t"))
    return d.select("meeting_id", "position", F.col("t").alias("plain"), clean(F.to_json(F.struct(F.col("t").alias("summary")))).alias("object"), clean(F.to_json(F.array("t", "t"))).alias("listed"))


@query(f"WITH {SAID} SELECT meeting_id, position, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS text, CASE WHEN position % 2 = 0 THEN speaker END AS quote FROM said")
def decision_shapes(spark, sf):
    t = F.regexp_replace("text", "[^A-Za-z ]", "")
    raw = F.when(F.pmod("position", F.lit(2)) == 0, F.to_json(F.struct(t.alias("text"), F.col("speaker").alias("quote")))).otherwise(t)
    return said(spark, sf).select("meeting_id", "position", X.decision_shape(raw).alias("d")).select("meeting_id", "position", "d.text", "d.quote")


@query(
    f"""WITH {SAID}, f AS (SELECT meeting_id, position, trim(regexp_replace(regexp_replace(text, '[\\x{{0980}}-\\x{{0D7F}}]+', '', 'g'), '\\s+', ' ', 'g')) AS t FROM said),
r AS (SELECT meeting_id, position, CASE WHEN regexp_matches(t, '[{DEVA}]') THEN {"".join("regexp_replace(" for _ in V.ROMANISED)}t{"".join(f", '(?i)" + chr(92) + f"b{a}" + chr(92) + f"b', '{b}', 'g')" for a, b in V.ROMANISED.items())} ELSE t END AS t FROM f)
SELECT meeting_id, position, CASE WHEN t = '' OR regexp_matches(t, '[.!?…।]$') THEN t WHEN {count_letters("t", DEVA)} > length(t) * 0.3 THEN t || '।' WHEN regexp_matches(t, '[A-Za-z]') THEN t || '.' ELSE t END AS text FROM r"""
)
def tidy_texts(spark, sf):
    return said(spark, sf).select("meeting_id", "position", X.tidy(F.col("text")).alias("text"))


TOKENS = lambda t: f"list_distinct(regexp_extract_all(lower({t}), '[{DEVA}]+|[A-Za-z0-9'']+'))"


@query(
    f"""WITH {SAID}, c AS (SELECT meeting_id, position, text, CASE position % 3 WHEN 0 THEN text WHEN 1 THEN text || ' entirely new words' ELSE '' END AS cleaned FROM said), k AS (SELECT *, {TOKENS("text")} AS a, {TOKENS("cleaned")} AS b FROM c)
SELECT meeting_id, position, len(list_filter(b, lambda w: NOT list_contains(a, w)))::INT AS new_tokens, CASE WHEN trim(cleaned) = '' THEN trim(text) = '' WHEN len(b) = 0 THEN true ELSE len(list_filter(b, lambda w: NOT list_contains(a, w) AND length(w) > 2)) / len(b) <= 0.08 END AS faithful FROM k"""
)
def faithful_texts(spark, sf):
    k = F.pmod("position", F.lit(3))
    cleaned = F.when(k == 0, F.col("text")).when(k == 1, F.concat("text", F.lit(" entirely new words"))).otherwise("")
    new = F.array_except(X.subset_tokens(cleaned), X.subset_tokens(F.col("text")))
    return said(spark, sf).select("meeting_id", "position", F.size(new).alias("new_tokens"), X.faithful(F.col("text"), cleaned).alias("faithful"))


# ---------------------------------------------------------------- numbers and times


@query(f"WITH {M}, b AS (SELECT id, (duration_seconds * 100000)::BIGINT * (id % 400) * 2 + 1 AS size FROM meetings) SELECT id, CASE WHEN size / 1048576 >= 1024 THEN printf('%.2f GB', size / 1048576 / 1024) ELSE printf('%.2f MB', size / 1048576) END AS label FROM b")
def byte_labels(spark, sf):
    size = F.round(F.col("duration_seconds") * 100_000).cast("bigint") * F.pmod("id", F.lit(400)) * 2 + 1
    return model.meetings(spark, sf).select("id", S.bytes_label(size).alias("label"))


@query(f"WITH {M} SELECT id, CASE id % 3 WHEN 0 THEN date_trunc('second', uploaded_at) WHEN 1 THEN date_trunc('second', uploaded_at) ELSE TIMESTAMP '2024-02-02 02:02:02' END AS parsed, strftime(uploaded_at, '%B ') || day(uploaded_at) || strftime(uploaded_at, ', %Y') AS day, strftime(uploaded_at, '%H:%M') AS time FROM meetings")
def iso_times(spark, sf):
    """Instants with Z, without an offset and missing; long dates and times."""
    from parley.plans.catalog import _ntz

    at, k = F.col("uploaded_at"), F.pmod("id", F.lit(3))
    iso = F.when(k == 0, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
    now = F.lit("2024-02-02 02:02:02").cast("timestamp")
    return _ntz(model.meetings(spark, sf).select("id", S.parse_iso(iso, now).alias("parsed"), S.display_date(at).alias("day"), S.display_time(at).alias("time")))


@query(f"WITH {VO}, r AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x * x)) / len(embedding)) AS rms, list_max(list_transform(embedding, lambda x: abs(x))) AS peak, len(list_filter(embedding, lambda x: abs(x) >= 0.2)) / len(embedding) AS clipped FROM voices) SELECT vec_id, round(rms, 6) AS rms, round(20 * log10(peak / rms), 6) AS crest, round(clipped, 6) AS clipped FROM r")
def signal_levels(spark, sf):
    e = F.col("embedding")
    return model.voices(spark, sf).select("vec_id", F.round(S.rms(e), 6).alias("rms"), F.round(S.crest_db(e), 6).alias("crest"), F.round(S.clipped_share(e, 0.2), 6).alias("clipped"))


@query(f"WITH {VO}, a AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x)) AS a FROM voices), m AS (SELECT vec_id, a, list_avg(a) AS mean FROM a) SELECT vec_id, mean >= 0.002 AND sqrt(list_avg(list_transform(a, lambda x: (x - mean) * (x - mean)))) <= 0.075 AS flat FROM m")
def flat_tones(spark, sf):
    return model.voices(spark, sf).select("vec_id", S.flat_tone(F.transform("embedding", lambda x: F.abs(x)), spread=0.075).alias("flat"))


@query(f"""WITH {VO}, p AS (SELECT vec_id, abs(embedding[1]) AS en, abs(embedding[2]) AS hi, abs(embedding[3]) AS kn FROM voices), n AS (SELECT vec_id, en / (en + hi) AS en, hi / (en + hi) AS hi, 0.0 AS mr FROM p)
SELECT vec_id, round(en, 6) AS en, round(hi, 6) AS hi, round(abs(en - hi), 3) AS margin, round(abs(en - hi), 3) < 0.15 AS mixed, CASE WHEN en >= 0.4 THEN 'en' WHEN vec_id % 2 = 0 THEN 'mr' WHEN en >= 0.25 THEN 'en' ELSE 'en' END AS chosen FROM n""")
def posteriors(spark, sf):
    """Posteriors over languages that are not all allowed, renormalised; margin, mixture and choice."""
    raw = F.create_map(F.lit("en"), F.abs(F.get("embedding", F.lit(0))), F.lit("hi"), F.abs(F.get("embedding", F.lit(1))), F.lit("kn"), F.abs(F.get("embedding", F.lit(2))))
    d = model.voices(spark, sf).withColumn("p", S.renormalise(raw, ["en", "hi"]))
    ranking = F.array_sort("p", lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).otherwise(0))
    d = d.withColumn("m", S.margin_and_mixed(ranking))
    en = F.get("p", F.lit(0))["p"]
    chosen = S.choose_language(F.lit("en"), en, F.when(F.pmod("vec_id", F.lit(2)) == 0, "mr"))
    return d.select("vec_id", F.round(en, 6).alias("en"), F.round(F.get("p", F.lit(1))["p"], 6).alias("hi"), "m.margin", "m.mixed", chosen.alias("chosen"))


@query(f"""WITH {SAID}, h AS (SELECT meeting_id, position, text, position % 5 / 4.0 AS ns, -(position % 4) / 2.0 - 0.1 AS lp, (end_ms - start_ms) / 4000.0 AS dur FROM said), n AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM h)
SELECT meeting_id, position, CASE WHEN dur > 0 AND n / dur > 8 THEN 'words_per_second' WHEN ns > 0.85 AND lp > -1.0 THEN 'silent_but_sure' WHEN ns > 0.6 AND lp < -1.0 AND lp > -1.5 THEN 'silent_and_unsure' END AS reason FROM n""")
def hallucination_reasons(spark, sf):
    silence, sure = F.pmod("position", F.lit(5)) / 4.0, -F.pmod("position", F.lit(4)) / 2.0 - 0.1
    d = said(spark, sf)
    return d.select("meeting_id", "position", S.hallucination(silence, sure, F.col("text"), (F.col("end_ms") - F.col("start_ms")) / 4000.0).alias("reason"))


@query(f"""WITH {VO} SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 0.5 ELSE least(vec_id % 40 / 20.0, 1.0) END::DOUBLE AS cluster, round(least((embedding[1] + 1) / 2, 1), 6) AS separation, least((embedding[1] + 1) / 2, 1) >= 0.45 AS accepted,
  CASE WHEN embedding[2] > 0 THEN embedding[2] WHEN embedding[3] > 0 THEN embedding[3] ELSE 7 END::DOUBLE AS duration, floor(least(greatest(embedding[4] * 4, 0), 1) * 100)::INT AS progress FROM voices""")
def confidences(spark, sf):
    e = lambda i: F.get("embedding", F.lit(i))
    count = F.when(F.pmod("vec_id", F.lit(5)) != 0, F.pmod("vec_id", F.lit(40)))
    s = S.separation_confidence(e(0), F.lit(1.0))
    return model.voices(spark, sf).select(
        "vec_id", S.cluster_confidence(count).alias("cluster"), F.round(s["confidence"], 6).alias("separation"), s["accepted"].alias("accepted"),
        S.effective_duration(F.lit(7.0), e(1), e(2)).alias("duration"), S.progress(e(3) * 4).alias("progress"),
    )


@query(f"WITH {VO}, k AS (SELECT label, list(vec_id ORDER BY vec_id) AS xs FROM voices GROUP BY 1) SELECT label, len(xs[-24:])::INT AS kept, xs[-24:][1] AS first FROM k")
def rolling_samples(spark, sf):
    d = model.voices(spark, sf).groupBy("label").agg(F.array_sort(F.collect_list("vec_id")).alias("xs"))
    last = S.keep_last(F.col("xs"))
    return d.select("label", F.size(last).alias("kept"), F.get(last, F.lit(0)).alias("first"))


# ---------------------------------------------------------------- audio


@query(f"WITH {VO}, q AS (SELECT vec_id, list_transform(embedding, lambda x: trunc(greatest(least(x::FLOAT, 1), -1) * 32767::FLOAT)::INT) AS q FROM voices) SELECT vec_id, (len(q) * 2)::INT AS pcm_bytes, (len(q) * 2 + 44)::INT AS wav_bytes, round(list_sum(list_transform(q, lambda x: x / 32768.0)), 5) AS total FROM q")
def pcm_round_trip(spark, sf):
    """Samples to a WAV file and to PCM and back, as columns."""
    d = model.voices(spark, sf).select("vec_id", F.col("embedding").cast("array<float>").alias("x")).withColumn("wav", signal.wav_encoded("x"))
    d = d.withColumn("pcm", F.substring("wav", 45, 1 << 30)).withColumn("back", signal.pcm_decoded("pcm")).withColumn("again", signal.wav_decoded("wav"))
    total = F.aggregate("back", F.lit(0.0), lambda a, x: a + x)
    same = F.when(F.col("back") == F.col("again"), total)
    return d.select("vec_id", F.octet_length("pcm").alias("pcm_bytes"), F.octet_length("wav").alias("wav_bytes"), F.round(same, 5).alias("total"))


def _second(spark, sf):
    """Vectors as sounds of two seconds at 32 samples a second."""
    return model.voices(spark, sf).select("vec_id", F.col("embedding").cast("array<float>").alias("x"))


@query(f"WITH {VO} SELECT vec_id, round(sqrt(list_avg(list_transform(embedding[1:32], lambda x: x::FLOAT::DOUBLE * x::FLOAT::DOUBLE))), 6) AS first, round(sqrt(list_avg(list_transform(embedding[33:64], lambda x: x::FLOAT::DOUBLE * x::FLOAT::DOUBLE))), 6) AS second FROM voices")
def second_loudness(spark, sf):
    d = _second(spark, sf).withColumn("rms", signal.loudness("x", 32))
    return d.select("vec_id", F.round(F.get("rms", F.lit(0)), 6).alias("first"), F.round(F.get("rms", F.lit(1)), 6).alias("second"))


@query()
def spectra(spark, sf):
    """Rolloff, dominant tone, level drift and loudness after a notch, of each vector as a sound."""
    d = _second(spark, sf).select("vec_id", signal.spectrum("x", 32).alias("s"))
    return d.select("vec_id", "s.rolloff", "s.tone", "s.drift", "s.notched_rms")


@query()
def upload_profiles(spark, sf):
    return _second(spark, sf).select("vec_id", signal.profiled("x", 32).alias("p")).select("vec_id", "p.*")


@query(f"WITH {VO}, g AS (SELECT vec_id, 64 / 32.0 AS seconds, sqrt(list_avg(list_transform(embedding, lambda x: x * x))) AS rms FROM voices) SELECT vec_id FROM g WHERE seconds >= 0.35 AND rms >= 0.002")
def speech_gate(spark, sf):
    d = model.voices(spark, sf).select("vec_id", F.lit(2.0).alias("seconds"), S.rms(F.col("embedding")).alias("rms"))
    return signal.speech_gate(d).select("vec_id")


@query(f"WITH {VO} SELECT vec_id, (len(embedding) * 2 // 64)::INT AS frames, (len(embedding) * 2 % 64 + 6)::INT AS left_over FROM voices")
def audio_frames(spark, sf):
    """Two chunks of bytes framed by 32 samples, the remainder held back."""
    d = model.voices(spark, sf).select("vec_id", F.col("embedding").cast("array<float>").alias("x")).withColumn("pcm", F.substring(signal.wav_encoded("x"), 45, 1 << 30))
    return d.select("vec_id", signal.framed(F.concat("pcm", F.unhex(F.lit("010203040506"))), 32).alias("f")).select("vec_id", "f.frames", "f.left_over")

