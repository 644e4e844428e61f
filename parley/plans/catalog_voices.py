"""Registered queries over voice vectors: profiles, fragments, assignments, merges, each beside the DuckDB SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import scalar as S
from parley.functions import text as X
from parley.operators import clustering, names, store, vectors, voices
from parley.plans.catalog import _ntz, _profiles, _recordings, query
from parley.sources import duck, model

L, VO = duck.LINES, duck.VOICES
REC = f"{VO}, r AS (SELECT vec_id // 25 AS meeting_id, (vec_id % 25)::INT AS position, vec_id, label, embedding FROM voices)"
MEAN = lambda keys, rows: f"(SELECT {keys}, list(x ORDER BY i) AS v FROM (SELECT {keys}, i, avg(embedding[i]) AS x FROM {rows}, range(1, 65) t(i) GROUP BY ALL) GROUP BY ALL)"


def _pieces(spark, sf):
    """Recordings as pieces of 2 s under the label of their voice modulo 4; every other label named."""
    k = F.pmod("label", F.lit(4))
    label = F.concat(F.lit("Speaker_0"), k)
    return _recordings(spark, sf).select(
        "meeting_id", "position", "vec_id", "embedding", (F.col("position") * 2500).cast("bigint").alias("start_ms"), (F.col("position") * 2500 + 2000).cast("bigint").alias("end_ms"),
        label.alias("speaker_label"), F.when(k == 0, "Asha").when(k == 1, "Ravi").otherwise(label).alias("speaker"),
    )


PIECES = f"""{REC}, pc AS (SELECT meeting_id, position, vec_id, embedding, 'Speaker_0' || (label % 4) AS speaker_label, CASE label % 4 WHEN 0 THEN 'Asha' WHEN 1 THEN 'Ravi' ELSE 'Speaker_0' || (label % 4) END AS speaker FROM r),
rk AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, speaker_label ORDER BY position) AS n FROM pc),
lv AS {MEAN("meeting_id, speaker_label", "(SELECT * FROM rk WHERE n <= 15)")}"""


@query(f"WITH {PIECES} SELECT meeting_id, speaker_label, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS first, len(v)::INT AS dims FROM lv")
def label_vectors(spark, sf):
    """Each label's mean over its first 30 s."""
    d = voices.label_vectors(_pieces(spark, sf))
    return d.select("meeting_id", "speaker_label", F.round(F.get("centroid", F.lit(0)), 5).alias("first"), F.size("centroid").alias("dims"))


PROFILES = f"pf AS (SELECT 'voice-' || label AS name, v AS centroid FROM {MEAN('label', 'voices')})"


@query(
    f"""WITH {PIECES}, {PROFILES}, s AS (SELECT meeting_id, speaker_label, name, round(list_cosine_similarity(v, centroid), 6) AS score FROM lv, pf),
t AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY meeting_id, speaker_label ORDER BY score DESC, name)),
b AS (SELECT meeting_id, speaker_label, CASE WHEN score < 0.72 OR (second >= 0.72 AND score - second < 0.03) THEN 'Unknown' ELSE name END AS best, round(score, 3) AS score FROM t WHERE rn = 1),
o AS (SELECT meeting_id, speaker_label, any_value(speaker) AS old_name FROM pc GROUP BY 1, 2)
SELECT o.meeting_id, o.speaker_label, old_name, CASE WHEN old_name NOT LIKE 'Speaker%' THEN old_name WHEN best = 'Unknown' THEN old_name ELSE best END AS identified_as,
  CASE WHEN old_name NOT LIKE 'Speaker%' THEN 1.0 ELSE score END::DOUBLE AS confidence, old_name LIKE 'Speaker%' AND best <> 'Unknown' AS matched FROM o JOIN b USING (meeting_id, speaker_label)"""
)
def identified_labels(spark, sf):
    return voices.identify_labels(_pieces(spark, sf), _profiles(spark, sf).select("name", "centroid"))


#: Weights by which a fragment's voice is mixed from Asha's, Ravi's and a third: sure, weak, turn taking, none.
MIXES = [(0.95, 0.10, 0.05), (0.62, 0.10, 0.80), (0.44, 0.55, 0.75), (0.10, 0.10, 0.95)]


def _fragments(spark, sf):
    """Recordings whose first two voices are Asha's and Ravi's, followed by a short fragment that is mixed from voices."""
    r = _recordings(spark, sf).filter("position < 3")
    e = r.groupBy("meeting_id").agg(*[F.max_by("embedding", F.when(F.col("position") == k, 1)).alias(f"e{k}") for k in range(3)])
    k = F.pmod("meeting_id", F.lit(len(MIXES))).cast("int")
    weights = F.get(F.array(*[F.array(*map(F.lit, m)) for m in MIXES]), k)
    both = F.zip_with("e0", "e1", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    mixed = F.zip_with(both, "e2", lambda p, c: p["a"] * F.col("wt")[0] + p["b"] * F.col("wt")[1] + c * F.col("wt")[2])
    d = e.withColumn("wt", weights).withColumn("mixed", mixed)
    row = lambda at, label, speaker, v: F.struct(F.lit(at).alias("position"), F.lit(label).alias("speaker_label"), F.lit(speaker).alias("speaker"), F.col(v).alias("embedding"))
    d = d.select("meeting_id", F.explode(F.array(row(0, "Speaker_01", "Ravi", "e1"), row(1, "Speaker_00", "Asha", "e0"), row(2, "Speaker_02", "Speaker_02", "mixed"))).alias("p")).select("meeting_id", "p.*")
    return d.withColumns({"start_ms": (F.col("position") * 2500).cast("bigint"), "end_ms": (F.col("position") * 2500 + 2000).cast("bigint")})


def _named(lines):
    return lines.filter(~X.is_generic(F.col("speaker")) & ~F.col("speaker").contains("+")).groupBy("meeting_id", "speaker_label").agg(F.min("speaker").alias("name"))


@query(
    f"""WITH {REC}, e AS (SELECT meeting_id, max(embedding) FILTER (position = 0) AS a, max(embedding) FILTER (position = 1) AS b, max(embedding) FILTER (position = 2) AS c FROM r GROUP BY 1 HAVING count(*) FILTER (position < 3) = 3),
m AS (SELECT *, {[list(x) for x in MIXES]}[meeting_id % {len(MIXES)} + 1] AS w FROM e), x AS (SELECT *, list_transform(range(1, 65), lambda i: a[i] * w[1] + b[i] * w[2] + c[i] * w[3]) AS v FROM m),
s AS (SELECT meeting_id, list_cosine_similarity(v, a) AS sa, list_cosine_similarity(v, b) AS sb FROM x),
t AS (SELECT *, CASE WHEN sa >= sb THEN 'Asha' ELSE 'Ravi' END AS best, greatest(sa, sb) AS top, least(sa, sb) AS second FROM s),
o AS (SELECT meeting_id, CASE WHEN top >= 0.78 THEN 'fragment_merge' WHEN top >= 0.45 AND top >= second + 0.08 THEN 'fragment_merge_weak' WHEN sb >= 0.40 AND (sa < 0 OR sb >= sa + 0.03) THEN 'turn_taking' END AS source, best, top, sb FROM t)
SELECT meeting_id, 'Speaker_02' AS speaker_label, CASE source WHEN 'turn_taking' THEN 'Ravi' ELSE best END AS name, round(CASE source WHEN 'turn_taking' THEN sb ELSE top END, 3)::DOUBLE AS confidence, source FROM o WHERE source IS NOT NULL"""
)
def fragment_merges(spark, sf):
    p = _fragments(spark, sf)
    return voices.fragment_merges(p, _named(p), voices.label_vectors(p))


@query(
    f"""WITH {L}, q AS (SELECT meeting_id, position, start_ms // 20 AS s, end_ms // 20 AS e, speaker_label, speaker FROM lines),
n AS (SELECT meeting_id, speaker_label, min(speaker) AS name FROM q WHERE NOT contains(speaker, 'Speaker') AND NOT contains(speaker, '+') GROUP BY 1, 2),
pp AS (SELECT meeting_id, list_sort(list(DISTINCT name)) AS people FROM n GROUP BY 1 HAVING count(DISTINCT name) = 2),
g AS (SELECT meeting_id, speaker_label, arg_min(speaker, position) AS display, sum(greatest(e - s, 0)) AS ms FROM q GROUP BY 1, 2),
pv AS (SELECT *, last_value(CASE WHEN NOT contains(speaker, 'Speaker_0') THEN speaker END IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM q),
f AS (SELECT meeting_id, speaker_label, arg_min({{'v': prev}}, position).v AS prev FROM pv WHERE contains(speaker, 'Speaker_0') GROUP BY 1, 2)
SELECT meeting_id, g.speaker_label, list_filter(people, lambda x: lower(x) <> lower(prev))[1] AS name, 0.0::DOUBLE AS confidence, 'turn_taking' AS source
FROM g JOIN pp USING (meeting_id) JOIN f USING (meeting_id, speaker_label) WHERE display LIKE 'Speaker%' AND ms <= 4000 AND prev IS NOT NULL AND (meeting_id, g.speaker_label) NOT IN (SELECT meeting_id, speaker_label FROM n)"""
)
def fragment_merges_unheard(spark, sf):
    """Without voices, lines twenty times as fast: the other of exactly two people."""
    fast = {c: F.floor(F.col(c) / 20) for c in ("start_ms", "end_ms")}
    lines = model.lines(spark, sf).withColumns(fast)
    return voices.fragment_merges(lines, _named(lines))


@query()
def collapsed_splits(spark, sf):
    one = _pieces(spark, sf).withColumns({"speaker_label": F.lit("Speaker_00"), "speaker": F.when(F.pmod("position", F.lit(10)) < 6, "Asha").otherwise("Ravi")})
    return voices.split_collapsed(one)


@query()
def resolved_voices(spark, sf):
    p = _pieces(spark, sf).withColumn("text", F.when(F.col("position") == 3, "my name is meera").otherwise(F.lit("")))
    centroids = voices.label_vectors(p)
    key = F.struct("meeting_id", F.col("speaker_label").alias("label")).alias("key")
    matches = vectors.match_profiles(centroids.select(key, F.col("centroid").alias("embedding")), _profiles(spark, sf), "key")
    return voices.resolve_names(p, matches.select("key.*", "name", F.col("score").alias("confidence")), centroids)


CAND = f"{REC}, c AS (SELECT meeting_id, 'S' || (position % 5) AS label, 'voice-' || min(label) AS name, round(max(embedding[1]), 6) AS confidence FROM r GROUP BY 1, 2)"


def _candidates(spark, sf):
    label = F.concat(F.lit("S"), F.pmod("position", F.lit(5)))
    return _recordings(spark, sf).groupBy("meeting_id", label.alias("label")).agg(F.concat(F.lit("voice-"), F.min("label")).alias("name"), F.round(F.max(F.get("embedding", F.lit(0))), 6).alias("confidence"))


@query(f"WITH {CAND}, t AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, name ORDER BY confidence DESC, label) AS rn FROM c) SELECT meeting_id, label, name, confidence FROM t WHERE rn = 1")
def unique_assignment(spark, sf):
    return vectors.unique_assignment(_candidates(spark, sf))


def _zeroed(spark, sf):
    zero = F.transform("embedding", lambda x: F.lit(0.0))
    return _recordings(spark, sf).withColumn("embedding", F.when(F.pmod("position", F.lit(4)) == 1, zero).otherwise(F.col("embedding")))


@query(f"WITH {REC} SELECT r.meeting_id, r.position, CASE WHEN r.position % 4 <> 1 THEN r.label ELSE p.label END AS filled_label FROM r LEFT JOIN r p ON r.meeting_id = p.meeting_id AND p.position = r.position - 1")
def zero_vectors_filled(spark, sf):
    """Every fourth row without a vector takes the label of the row before, the earlier of two as near."""
    return vectors.fill_zero_vectors(_zeroed(spark, sf), "meeting_id", "position").select("meeting_id", "position", "filled_label")


@query(f"WITH {REC}, f AS (SELECT meeting_id, label, min(position) AS first FROM r GROUP BY 1, 2), n AS (SELECT meeting_id, label, 'Speaker_' || lpad((row_number() OVER (PARTITION BY meeting_id ORDER BY first) - 1)::VARCHAR, 2, '0') AS name FROM f) SELECT meeting_id, position, CASE WHEN position % 6 = 0 THEN 'both' ELSE name END AS speaker_label, CASE WHEN position % 6 = 0 THEN 'x' ELSE 'Unknown' END AS identified_as FROM r JOIN n USING (meeting_id, label)")
def relabelled(spark, sf):
    d = _recordings(spark, sf).withColumns({"speaker_label": F.lit("both"), "identified_as": F.lit("x"), "is_overlap": F.pmod("position", F.lit(6)) == 0})
    return vectors.relabel(d, "meeting_id", "position").select("meeting_id", "position", "speaker_label", "identified_as")


@query(
    f"""WITH {REC}, {PROFILES}, s AS (SELECT meeting_id, position AS span, name, list_cosine_similarity(embedding, centroid) AS score FROM r, pf), b AS (SELECT meeting_id, span, arg_max(name, score) AS name, max(score) AS score FROM s GROUP BY 1, 2)
SELECT meeting_id, span, CASE WHEN row_number() OVER (PARTITION BY meeting_id, name ORDER BY score DESC, span) = 1 THEN name END AS name, round(score, 6) AS score FROM b"""
)
def nearest_candidates(spark, sf):
    """Every voice of each recording against every profile as its candidates."""
    spans = _recordings(spark, sf).select("meeting_id", F.col("position").alias("span"), "embedding")
    candidates = spans.select("meeting_id").distinct().crossJoin(F.broadcast(_profiles(spark, sf).select("name", "centroid")))  # ten labels
    return vectors.nearest_candidate(spans, candidates, ["meeting_id"]).withColumn("score", F.round("score", 6))


@query(f"WITH {REC}, k AS (SELECT meeting_id, position, ['S0', 'S' || (position % 3), 'S9'] AS cs FROM r), f AS (SELECT *, list_filter(cs, lambda c: c IN ('S0', 'S1')) AS kept FROM k) SELECT meeting_id, position, len(kept) >= 2 AS is_overlap, CASE WHEN len(kept) >= 2 THEN array_to_string(kept, ' + ') ELSE kept[1] END AS speaker_label FROM f")
def pruned_candidates(spark, sf):
    d = _recordings(spark, sf).withColumns({"candidate_labels": F.array(F.lit("S0"), F.concat(F.lit("S"), F.pmod("position", F.lit(3))), F.lit("S9")), "speaker_label": F.lit(""), "is_overlap": F.lit(True), "confidence": F.lit(None).cast("double")})
    counts = F.create_map(F.lit("S0"), F.lit(9), F.lit("S1"), F.lit(2), F.lit("S2"), F.lit(1))
    return vectors.prune_candidates(d, counts, F.lit(3)).select("meeting_id", "position", "is_overlap", "speaker_label")


@query(
    f"""WITH RECURSIVE {VO}, z AS (SELECT count(*) AS n FROM voices), m AS (SELECT vec_id AS absorbed, (vec_id * 7 + 3) % n AS kept FROM voices, z WHERE (vec_id * 7 + 3) % 9 <> 0),
walk AS (SELECT absorbed, absorbed AS here, [absorbed] AS seen FROM m UNION ALL SELECT w.absorbed, m.kept, list_append(seen, m.kept) FROM walk w JOIN m ON w.here = m.absorbed WHERE len(list_distinct(seen)) = len(seen)),
fin AS (SELECT absorbed, arg_max(here, len(seen)) AS survivor FROM walk GROUP BY 1) SELECT * FROM fin"""
)
def merge_survivors(spark, sf):
    """Chains and cycles of merges over all vectors' ids; a cycle is entered where the walk first meets a label again."""
    v = model.voices(spark, sf)
    to = F.col("vec_id") * 7 + 3
    m = v.crossJoin(F.broadcast(v.agg(F.count("*").alias("n")))).select(F.col("vec_id").alias("absorbed"), F.when(F.pmod(to, F.lit(9)) != 0, F.pmod(to, F.col("n"))).alias("kept"))  # one row
    return vectors.survivors(m.filter("kept IS NOT NULL"))


@query()
def count_errors(spark, sf):
    """Speakers found at each distance against the voices that are there."""
    seg = _recordings(spark, sf).select("meeting_id", "position", "label", "embedding")
    true = seg.groupBy("meeting_id").agg(F.countDistinct("label").alias("expected"))
    found = clustering.distance_sweep(seg, [0.4, 0.55, 0.7, 0.85])
    return vectors.count_errors(found.join(true, "meeting_id"))


@query(
    f"""WITH {REC}, st AS (SELECT meeting_id, label, count(*) AS n, count(*) * 2000 AS ms FROM r GROUP BY 1, 2), tot AS (SELECT meeting_id, count(*) AS lines, count(*) * 2000 AS total FROM r GROUP BY 1), cv AS {MEAN("meeting_id, label", "r")},
s AS (SELECT st.meeting_id, st.label, v, n < greatest(2, lines // 25) OR ms < greatest(3000, total / greatest(2 * lines, 1)) AS fragment FROM st JOIN tot USING (meeting_id) JOIN cv USING (meeting_id, label)),
p AS (SELECT a.meeting_id, list_cosine_similarity(a.v, b.v) AS sim, a.fragment OR b.fragment AS weak FROM s a JOIN s b ON a.meeting_id = b.meeting_id AND a.label < b.label AND a.label % 4 = b.label % 4)
SELECT meeting_id, bool_and(sim >= 0.78 OR (sim >= 0.40 AND weak)) AS supported FROM p GROUP BY 1"""
)
def reduction_gates(spark, sf):
    r = _recordings(spark, sf)
    joined = vectors.co_membership(r.withColumn("label", F.pmod("label", F.lit(4))), r, ["meeting_id", "position"])
    n = r.groupBy("meeting_id").agg(F.count("*").alias("lines"), (F.count("*") * 2000).alias("total_ms"))
    each = r.groupBy("meeting_id", "label").agg(F.count("*").alias("count"), (F.count("*") * 2000).alias("ms"))
    stats = each.join(vectors.centroids(r, ["meeting_id", "label"]).drop("samples"), ["meeting_id", "label"]).join(n, "meeting_id")
    return vectors.reduction_gate(joined, stats, "meeting_id")


# ---------------------------------------------------------------- profiles


def _stored(spark, sf):
    return _profiles(spark, sf).select("name", F.col("centroid").cast("array<double>").alias("centroid"), F.lit(3).alias("sample_count"))


def _samples(spark, sf):
    """A sample of every voice: under its own name in capitals, or from label 5 on as a guest."""
    name = F.when(F.col("label") < 5, F.concat(F.lit("VOICE-"), "label")).otherwise(F.concat(F.lit("guest-"), "label"))
    return model.voices(spark, sf).groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(name.alias("name"), "embedding")


ENROLL = f"""{VO}, n AS (SELECT DISTINCT label FROM voices), e AS (SELECT 'voice-' || label AS name, true AS known, label < 5 AS sampled FROM n UNION ALL SELECT 'Guest-' || label, false, true FROM n WHERE label >= 5)"""


@query(f"WITH {ENROLL} SELECT name, CASE WHEN known AND sampled THEN 4 WHEN known THEN 3 ELSE 1 END::INT AS sample_count, NOT known AS created, false AS overwritten, 1.0::DOUBLE AS length FROM e")
def enrolled_voices(spark, sf):
    d = store.enroll(_stored(spark, sf), _samples(spark, sf))
    return d.select("name", "sample_count", "created", "overwritten", F.round(S.norm(F.col("centroid")), 6).alias("length"))


@query(f"WITH {ENROLL} SELECT name, CASE WHEN sampled THEN 1 ELSE 3 END::INT AS sample_count, NOT known AS created, known AND sampled AS overwritten FROM e")
def overwritten_voices(spark, sf):
    return store.enroll(_stored(spark, sf), _samples(spark, sf), overwrite=True).select("name", "sample_count", "created", "overwritten")


@query(f"WITH {ENROLL} SELECT name FROM e WHERE known AND name <> 'voice-2'")
def removed_profile(spark, sf):
    return store.remove_profile(_stored(spark, sf), "voice-2").select("name")


@query("SELECT count(*) AS profiles, max(ts) AS updated_at FROM events")
def profile_stamp(spark, sf):
    return _ntz(store.profile_stamp(model.table(spark, sf, "events").withColumnRenamed("ts", "updated_at")))


@query(f"WITH {VO}, l AS (SELECT label, count(*)::INT AS n FROM voices GROUP BY 1) SELECT 'voice-' || label AS name, CASE WHEN label % 2 = 0 THEN n ELSE 1 END::INT AS sample_count, 64::INT AS dims FROM l")
def imported_profiles(spark, sf):
    """Profiles in both historical shapes, an object with a count or a bare list."""
    d = _profiles(spark, sf)
    number = F.regexp_extract("name", r"(\d+)$", 1).cast("int")
    c = F.col("centroid").cast("array<float>")
    raw = d.select("name", F.when(number % 2 == 0, F.to_json(F.struct(c.alias("centroid"), F.col("samples").alias("sample_count")))).otherwise(F.to_json(c)).alias("profile"))
    return model.speaker_profiles(raw).select("name", "sample_count", F.size("centroid").alias("dims"))


@query(f"WITH {L}, {REC} SELECT l.meeting_id, l.position, vec_id FROM lines l JOIN r ON l.meeting_id = r.meeting_id AND l.position = r.position")
def lines_with_vectors(spark, sf):
    """Transcripts joined to their vectors by ordinal, as far as both go."""
    v = _recordings(spark, sf).select("meeting_id", "position", "vec_id", "embedding")
    return names.with_vectors(model.lines(spark, sf), v, common_prefix=True).select("meeting_id", "position", "vec_id")
