"""Names for voices: enrolled profiles, fragments of one meeting, collapsed lines, and the order in which sources are heard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import scalar as S
from parley.functions import text as X
from parley.helpers import with_fold
from parley.operators import names, turns, vectors

SURE, WEAK, APART, INCONCLUSIVE, LEAD = 0.78, 0.45, 0.08, 0.40, 0.03
SHORT_MS, SPLIT = 4_000, 0.40


def label_vectors(pieces: DataFrame) -> DataFrame:
    """(meeting_id, speaker_label, centroid): the mean vector of each label's pieces of 1.5 s and more, up to 30 s."""
    return vectors.mean_over_ranges(pieces, ["meeting_id", "speaker_label"]).drop("samples")


def identify_labels(pieces: DataFrame, profiles: DataFrame, bound: int = 5_000) -> DataFrame:
    """Each label of a meeting against the enrolled profiles (name, centroid): old_name, identified_as, confidence, matched.

    pieces: meeting_id, speaker_label, speaker, start_ms, end_ms, embedding. Labels that a person has named keep
    their name; labels without a usable piece stay unknown.
    """
    shown = pieces.groupBy("meeting_id", "speaker_label").agg(F.max_by(F.coalesce("speaker", "speaker_label"), F.struct("start_ms", "end_ms")).alias("old_name"))
    named = ~(F.col("old_name").startswith("Speaker_") | F.col("old_name").startswith("SPEAKER_") | (F.lower("old_name") == "unknown"))
    key = F.struct("meeting_id", "speaker_label").alias("key")
    queries = label_vectors(pieces).select(key, F.col("centroid").alias("embedding"))
    found = vectors.match_profiles(queries, profiles, "key", block=bound).select("key.*", F.col("name").alias("best"), "score")
    d = shown.join(found, ["meeting_id", "speaker_label"], "left").withColumn("named", named)
    matched = ~F.col("named") & F.coalesce(F.col("best") != "Unknown", F.lit(False))
    who = F.when(F.col("named") | F.col("score").isNotNull() & ~matched, F.col("old_name")).when(matched, F.col("best")).otherwise("Unknown")
    sure = F.when(F.col("named"), F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0)))
    return d.select("meeting_id", "speaker_label", "old_name", who.alias("identified_as"), sure.alias("confidence"), matched.alias("matched"))


def fragment_merges(lines: DataFrame, named: DataFrame, centroids: DataFrame | None = None) -> DataFrame:
    """Generic labels of a meeting given a name that is already used in it: meeting_id, speaker_label, name, confidence, source.

    named: meeting_id, speaker_label, name. centroids: meeting_id, speaker_label, centroid, if voices are at hand. In
    order: a voice as near as SURE; for a label of SHORT_MS or less, one that is WEAK and APART from the next; else, after
    another person's turn, the best of the others if INCONCLUSIVE or better and ahead of that person; without any named
    voice, the other of exactly two people.
    """
    ordered = lines.withColumn("display", F.coalesce("speaker", "speaker_label"))
    shown = ordered.groupBy("meeting_id", "speaker_label").agg(
        F.min_by("display", F.struct("start_ms", "position")).alias("display"), F.sum(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).alias("ms")
    )
    before = turns.previous_human(lines.withColumn("speaker", F.coalesce("speaker", "speaker_label"))).select("meeting_id", "speaker_label", F.col("previous_speaker").alias("prev"))
    left = shown.join(named.select("meeting_id", "speaker_label"), ["meeting_id", "speaker_label"], "left_anti").filter(X.is_generic(F.col("display"))).join(before, ["meeting_id", "speaker_label"], "left")
    people = named.groupBy("meeting_id").agg(F.array_sort(F.collect_set("name")).alias("people"))
    left = left.join(people, "meeting_id")
    if centroids is None:
        centroids = lines.sparkSession.createDataFrame([], "speaker_label string, centroid array<double>").withColumn("meeting_id", F.lit(None).cast(lines.schema["meeting_id"].dataType))
    voices = named.join(centroids, ["meeting_id", "speaker_label"]).select("meeting_id", F.col("speaker_label").alias("other"), "name", F.col("centroid").alias("theirs"))
    pairs = left.join(centroids, ["meeting_id", "speaker_label"]).join(voices, "meeting_id").withColumn("sim", S.cosine(F.col("centroid"), F.col("theirs")))
    same = F.lower("name") == F.lower(F.coalesce("prev", F.lit("")))
    w = Window.partitionBy("meeting_id", "speaker_label").orderBy(F.desc("sim"), "other")
    best = pairs.withColumn("r", F.row_number().over(w)).groupBy("meeting_id", "speaker_label").agg(
        F.max(F.when(F.col("r") == 1, F.col("name"))).alias("best"), F.max("sim").alias("top"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("sim"))), F.lit(-1.0)).alias("second"),
        F.max(F.when(same, F.col("sim"))).alias("prev_sim"), F.max_by(F.when(~same, F.col("name")), F.when(~same, F.struct("sim", F.reverse("other")))).alias("next"),
        F.max(F.when(~same, F.col("sim"))).alias("next_sim"),
    )
    voiced = voices.groupBy("meeting_id").agg(F.lit(True).alias("voiced"))
    d = left.join(best, ["meeting_id", "speaker_label"], "left").join(voiced, "meeting_id", "left")
    short, prev = F.col("ms") <= SHORT_MS, F.col("prev").isNotNull()
    ahead = (F.coalesce("prev_sim", F.lit(-1.0)) < 0) | (F.col("next_sim") >= F.col("prev_sim") + LEAD)
    other = F.try_element_at(F.filter("people", lambda n: F.lower(n) != F.lower(F.col("prev"))), F.lit(1))
    weak = short & (F.col("top") >= WEAK) & (F.col("top") >= F.col("second") + APART)
    turn = short & prev & F.col("top").isNotNull() & (F.col("next_sim") >= INCONCLUSIVE) & ahead
    two = short & prev & F.col("voiced").isNull() & (F.size("people") == 2)
    pick = lambda name, sure, source: F.struct(name.alias("name"), F.round(sure.cast("double"), 3).alias("confidence"), F.lit(source).alias("source"))
    chosen = (
        F.when(F.col("top") >= SURE, pick(F.col("best"), F.col("top"), "fragment_merge")).when(weak, pick(F.col("best"), F.col("top"), "fragment_merge_weak"))
        .when(turn, pick(F.col("next"), F.col("next_sim"), "turn_taking")).when(two, pick(other, F.lit(0.0), "turn_taking"))
    )
    return d.withColumn("chosen", chosen).filter("chosen.name IS NOT NULL").select("meeting_id", "speaker_label", "chosen.*")


def split_collapsed(lines: DataFrame, least: float = SPLIT, sure: float = SURE) -> DataFrame:
    """Lines that go on under the same label and name though the voice has changed: position, old and new speaker, confidence, split_only.

    lines: meeting_id, position, start_ms, speaker_label, speaker, embedding (null where there is no usable audio). The line
    goes to the nearest other named voice of the meeting if that is `sure`, and counts as that speaker for the line after
    it. A meeting's lines stream in order through one task, holding one line and the meeting's named voices.
    """
    people = lines.filter(~X.is_generic(F.col("speaker")) & (F.coalesce("speaker", F.lit("")) != "") & F.col("embedding").isNotNull())
    voices = vectors.centroids(people, ["meeting_id", "speaker"]).groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("speaker", "centroid"))).alias("voices"))
    near = F.array_max(F.transform(F.filter("voices", lambda v: F.lower(v["speaker"]) != F.lower(F.col("speaker"))), lambda v: F.struct(S.cosine(F.col("embedding"), v["centroid"]).alias("sim"), v["speaker"].alias("name"))))
    w = Window.partitionBy("meeting_id").orderBy("start_ms", "position")
    d = lines.join(voices, "meeting_id", "left").withColumn("near", near)
    before = F.lag("embedding").over(w)
    d = d.withColumn("dist", F.when(F.col("embedding").isNotNull() & before.isNotNull(), 1 - S.cosine(F.col("embedding"), before)))
    d = d.select("meeting_id", "position", "start_ms", "speaker_label", "speaker", "dist", F.col("near.sim").alias("sim"), F.col("near.name").alias("name"))

    def step(z, label, speaker, dist, sim, name):
        """The line before counts as whom it was given to."""
        if dist is None or (label, speaker) != z or dist < least:
            return (label, speaker), None
        moved = sim is not None and sim >= sure
        return (label, name if moved else speaker), moved

    d = with_fold(d, "meeting_id", ["start_ms", "position"], ["speaker_label", "speaker", "dist", "sim", "name"], (None, None), step, "moved", T.BooleanType())
    return d.filter("moved IS NOT NULL").select(
        "meeting_id", "position", F.col("speaker").alias("old_speaker"), F.when(F.col("moved"), F.col("name")).otherwise(F.col("speaker")).alias("new_speaker"),
        F.round(F.when(F.col("moved"), F.col("sim")).otherwise(F.col("dist")), 3).alias("confidence"), (~F.col("moved")).alias("split_only"),
    )


def resolve_names(lines: DataFrame, matches: DataFrame, centroids: DataFrame) -> DataFrame:
    """(meeting_id, speaker_label, name, source): profile, self-introduction, greeting, a named voice of the meeting, turn-taking.

    matches: meeting_id, label, name, confidence of labels against profiles, each name for its best label only. An
    earlier source wins a label.
    """
    profile = vectors.unique_assignment(matches).select("meeting_id", F.col("label").alias("speaker_label"), "name")
    first = names.first_claims(profile, names.introductions(lines), names.mutual_greetings(lines))
    mine = centroids.join(first.select("meeting_id", "speaker_label"), ["meeting_id", "speaker_label"], "left_anti")
    theirs = centroids.join(first, ["meeting_id", "speaker_label"]).select("meeting_id", F.col("speaker_label").alias("other"), "name", F.col("centroid").alias("theirs"))
    pairs = mine.join(theirs, "meeting_id").withColumn("sim", S.cosine(F.col("centroid"), F.col("theirs")))
    near = pairs.groupBy("meeting_id", "speaker_label").agg(F.max_by("name", F.struct("sim", F.reverse("other"))).alias("name"), F.max("sim").alias("sim")).filter(F.col("sim") >= SURE).drop("sim")
    heard = names.first_claims(profile, names.introductions(lines), names.mutual_greetings(lines), near)
    spoken = lines.filter(~X.is_generic(F.col("speaker"))).groupBy("meeting_id", "speaker_label").agg(F.min_by("speaker", "position").alias("name"))
    known = names.first_claims(heard.drop("source"), spoken).drop("source")
    turn = fragment_merges(lines, known).select("meeting_id", "speaker_label", "name", F.lit(4).alias("source"))
    late = turn.join(heard.select("meeting_id", "speaker_label"), ["meeting_id", "speaker_label"], "left_anti")
    label = F.element_at(F.array(*[F.lit(x) for x in ("profile", "introduction", "greeting", "voice", "turn_taking")]), F.col("source") + 1)
    return heard.unionByName(late).withColumn("source", label)
