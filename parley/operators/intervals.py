"""Joins and segmentations on time: every range join carries the meeting as an equality, so it is hashed, not nested."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import scalar as S
from parley.helpers import with_fold


def speaker_at(times: DataFrame, lines: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """Who speaks at each time (meeting_id, t_ms): the first begun of the lines that hold it, else the last one begun before.

    Holders come from a join on the meeting and a bucket of time, so a long meeting is no hot key and makes no square.
    The fallback is an as-of join without pairs: times and lines are sorted together and the last line carried forward.
    """
    last = F.greatest(F.col("end_ms") - 1, F.col("start_ms"))
    held = lines.select("meeting_id", "start_ms", "end_ms", "position", "speaker", F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor(last / bucket_ms))).alias("bucket"))
    asked = times.select("meeting_id", F.col("t_ms").cast("bigint").alias("t_ms")).distinct().withColumn("bucket", F.floor(F.col("t_ms") / bucket_ms))
    holds = (F.col("t_ms") >= F.col("start_ms")) & (F.col("t_ms") < F.col("end_ms"))
    holder = asked.join(held, ["meeting_id", "bucket"]).filter(holds).groupBy("meeting_id", "t_ms").agg(F.min_by(F.struct("speaker"), F.struct("start_ms", "position")).alias("holder"))
    line = F.struct("start_ms", "speaker")
    a = lines.select("meeting_id", F.col("start_ms").alias("at"), F.lit(0).alias("kind"), "position", line.alias("line"), F.lit(None).cast("bigint").alias("t_ms"))
    b = times.select("meeting_id", F.col("t_ms").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(a.schema["position"].dataType).alias("position"), F.lit(None).cast(a.schema["line"].dataType).alias("line"), F.col("t_ms").cast("bigint").alias("t_ms"))
    w = Window.partitionBy("meeting_id").orderBy("at", "kind", "position").rowsBetween(Window.unboundedPreceding, 0)
    d = a.unionAll(b).withColumn("found", F.last("line", ignorenulls=True).over(w)).filter("kind = 1")
    d = d.join(holder, ["meeting_id", "t_ms"], "left")
    inside = F.col("holder").isNotNull()
    return d.select("meeting_id", "t_ms", F.when(inside, F.col("holder.speaker")).otherwise(F.col("found.speaker")).alias("speaker"), inside.alias("inside"))


def _buckets(from_ms, to_ms, bucket_ms: int):
    """The buckets of time that [from_ms, to_ms) touches; an empty or inverted span touches the one where it starts."""
    return F.explode(F.sequence(F.floor(from_ms / bucket_ms), F.greatest(F.floor((to_ms - 1) / bucket_ms), F.floor(from_ms / bucket_ms))))


def word_owner(words: DataFrame, windows: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """Words (meeting_id, word_no, start_ms, end_ms) to the window (win, w_start, w_end) that holds their midpoint; half-open, so one at most.

    Joined on the meeting and a bucket of time.
    """
    mid = (F.col("start_ms") + F.col("end_ms")) / 2
    spread = windows.withColumn("bucket", _buckets(F.col("w_start"), F.col("w_end"), bucket_ms))
    at = words.withColumn("mid", mid).withColumn("bucket", F.floor(mid / bucket_ms))
    return at.join(spread, ["meeting_id", "bucket"]).filter((F.col("mid") >= F.col("w_start")) & (F.col("mid") < F.col("w_end"))).drop("mid", "bucket")


def overlapping(segments: DataFrame, windows: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """Segments that overlap each window; where none does, all of the meeting's.

    Overlaps are joined on the meeting and a bucket of time; only windows without one take the whole meeting.
    """
    own = [c for c in segments.columns if c != "meeting_id"]
    spread = windows.withColumn("bucket", _buckets(F.col("w_start"), F.col("w_end"), bucket_ms))
    parts = segments.withColumn("bucket", _buckets(F.col("start_ms"), F.col("end_ms"), bucket_ms))
    hit = (F.col("end_ms") > F.col("w_start")) & (F.col("start_ms") < F.col("w_end"))
    first = F.col("bucket") == F.greatest(F.floor(F.col("w_start") / bucket_ms), F.floor(F.col("start_ms") / bucket_ms))  # a pair meets in several buckets
    found = spread.join(parts, ["meeting_id", "bucket"]).filter(hit & first).select("meeting_id", *[c for c in windows.columns if c != "meeting_id"], *own)
    bare = windows.join(found.select("meeting_id", "win").distinct(), ["meeting_id", "win"], "left_anti")
    return found.unionByName(bare.join(segments, "meeting_id").select(found.columns))


def midpoint_texts(segments: DataFrame, windows: DataFrame, slack_ms: int = 200) -> DataFrame:
    """The distinct texts of segments whose midpoint lies in a window, give or take slack, in order."""
    mid = (F.col("start_ms") + F.col("end_ms")) / 2
    d = windows.join(segments.withColumn("mid", mid), "meeting_id").filter(F.col("mid").between(F.col("w_start") - slack_ms, F.col("w_end") + slack_ms))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "text"))), lambda x: x["text"])
    return d.groupBy("meeting_id", "win").agg(F.array_join(F.array_distinct(texts), " ").alias("text"))


def contained(lines: DataFrame, from_ms: int, to_ms: int | None = None) -> DataFrame:
    """Lines from a time on, up to another if given."""
    d = lines.filter(F.col("start_ms") >= from_ms)
    return d if to_ms is None else d.filter(F.col("end_ms") <= to_ms)


def change_points(distances: DataFrame, group: str, floor: float = 0.13, cap: float = 0.35) -> DataFrame:
    """Local maxima of consecutive distances (group, i, d) at or above a threshold from their median and spread."""
    med = distances.groupBy(group).agg(F.percentile("d", F.lit(0.5)).alias("med"), F.count("*").alias("n"))
    d = distances.join(med, group)
    mad = d.groupBy(group).agg(F.percentile(F.abs(F.col("d") - F.col("med")), F.lit(0.5)).alias("mad"))
    d = d.join(mad, group)
    raw = F.col("med") + F.greatest(1.5 * F.col("mad"), F.lit(0.05))
    d = d.withColumn("threshold", F.when(F.col("n") < 3, F.lit(floor)).otherwise(F.least(F.greatest(raw, F.lit(floor)), F.lit(cap))))
    w = Window.partitionBy(group).orderBy("i").rowsBetween(-1, 1)
    return d.withColumn("peak", F.max("d").over(w)).filter((F.col("d") >= F.col("threshold")) & (F.col("d") == F.col("peak"))).select(group, "i", "d", F.round("threshold", 6).alias("threshold"))


def consecutive_distances(vectors: DataFrame, group: str, order: str) -> DataFrame:
    """Cosine distance of each vector to the one before it."""
    from parley.functions.scalar import cosine

    before = F.lag("embedding").over(Window.partitionBy(group).orderBy(order))
    return vectors.withColumn("before", before).filter("before IS NOT NULL").select(group, F.col(order).alias("i"), (1 - cosine(F.col("embedding"), F.col("before"))).alias("d"))


def spaced(points: DataFrame, group: str, end_col: str, least_ms: int = 1_200) -> DataFrame:
    """Points (group, at_ms) kept greedily: each at least least_ms after the last kept one and before the end."""

    def step(last, at, stop):
        keep = at - last >= least_ms and stop - at >= least_ms
        return (at if keep else last), keep

    kept = with_fold(points.select(group, F.col("at_ms").cast("bigint").alias("at_ms"), end_col), group, ["at_ms"], ["at_ms", end_col], 0, step, "_keep", T.BooleanType())
    return kept.filter("_keep").select(group, "at_ms")


def smooth_labels(frames: DataFrame, group: str, order: str, label: str = "label") -> DataFrame:
    """Labels of overlapping frames by majority of themselves and both neighbours, gaps filled forward, then back.

    A tie goes to the frame's own label, then to the first in alphabetical order.
    """
    w = Window.partitionBy(group).orderBy(order)
    near = F.filter(F.array(F.lag(label).over(w), F.col(label), F.lead(label).over(w)), lambda x: x.isNotNull())
    d = frames.withColumn("near", near)
    votes = F.transform(F.array_distinct("near"), lambda x: F.struct(F.size(F.filter("near", lambda y: y == x)).alias("n"), x.eqNullSafe(F.col(label)).cast("int").alias("own"), x.alias("label")))
    best = F.array_sort(votes, lambda a, b: F.when(a["n"] != b["n"], b["n"] - a["n"]).when(a["own"] != b["own"], b["own"] - a["own"]).when(a["label"] < b["label"], -1).otherwise(1))
    d = d.withColumn("voted", F.try_element_at(best, F.lit(1))["label"])
    ahead = F.first("voted", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return d.withColumn("smooth", F.coalesce(F.last("voted", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), ahead)).drop("near", "voted")


def run_bounds(frames: DataFrame, group: str, order: str, center: str) -> DataFrame:
    """Where the smoothed label flips: midway between the centres of the two frames."""
    w = Window.partitionBy(group).orderBy(order)
    nxt, at = F.lead("smooth").over(w), F.lead(center).over(w)
    return frames.withColumn("next_label", nxt).withColumn("at", (F.col(center) + at) / 2).filter("next_label IS NOT NULL AND next_label <> smooth").select(group, "at", F.col("smooth").alias("from_label"), F.col("next_label").alias("to_label"))


def snap_to_quiet(bounds: DataFrame, frames: DataFrame, group: str, reach: float = 0.75) -> DataFrame:
    """Each boundary moved to the quietest frame (t, rms) within reach, the first of equals; it stays where there is none."""
    b = bounds.withColumn("bound", F.col("at"))
    near = b.join(frames, group).filter(F.abs(F.col("t") - F.col("at")) <= reach).groupBy(group, "bound").agg(F.min_by("t", F.struct("rms", "t")).alias("quiet"))
    return b.join(near, [group, "bound"], "left").withColumn("at", F.coalesce("quiet", "at")).drop("quiet", "bound")


def dominant_in_span(spans: DataFrame, frames: DataFrame, group: str) -> DataFrame:
    """The label of most frames whose centre lies in a span [from_t, to_t), ties by label."""
    d = spans.join(frames, group).filter("center >= from_t AND center < to_t").groupBy(group, "span", "smooth").agg(F.count("*").alias("n"))
    return d.groupBy(group, "span").agg(F.min_by("smooth", F.struct(-F.col("n"), "smooth")).alias("label"))


def absorb_short(pieces: DataFrame, group: str, least: float = 1.5) -> DataFrame:
    """Pieces (group, start, stop, label) shorter than `least` taken up, from the left, by the longer neighbour (the left of equals).

    A piece at an end has one neighbour. The neighbour keeps its label, and pieces of one label stay apart. What lies
    to the left of a piece is settled when it is reached, so one pass over the sorted pieces with the next one's length does it.
    """

    def step(state, start, stop, label, after):
        held, carried = state  # the settled piece before, and the span of a short one that the next takes up
        done = []
        if carried:
            start, stop = min(carried[0], start), max(carried[1], stop)
        here, carried = (start, stop, label), None
        if stop - start >= least or (held is None and after is None):
            if held:
                done.append(held)
            held = here
        elif held is not None and (after is None or held[1] - held[0] >= after):
            held = (min(held[0], start), max(held[1], stop), held[2])
        else:
            carried = (start, stop)
        if after is None and held:
            done.append(held)
        return (held, carried), [{"start": s, "stop": e, "label": x} for s, e, x in done]

    after = F.lead(F.col("stop") - F.col("start")).over(Window.partitionBy(group).orderBy("start", "stop"))
    kind = T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("stop", T.DoubleType()), T.StructField("label", T.StringType())]))
    d = pieces.select(group, "start", "stop", "label").withColumn("after", after)
    d = with_fold(d, group, ["start", "stop"], ["start", "stop", "label", "after"], (None, None), step, "done", kind)
    return d.select(group, F.explode("done").alias("p")).select(group, "p.*")


def tumbling_speech(seconds: DataFrame, group: str, width: int = 25, least: float = 0.05, whole_until: int = 60) -> DataFrame:
    """Speech windows (group, t, is_speech): a short file whole, a longer one in windows, silent ones dropped."""
    total = F.max("t").over(Window.partitionBy(group)) + 1
    d = seconds.withColumn("total", total).withColumn("win", F.when(F.col("total") <= whole_until, 0).otherwise(F.floor(F.col("t") / width)).cast("int"))
    by = d.groupBy(group, "win").agg(F.min("t").alias("from_t"), (F.max("t") + 1).alias("to_t"), F.avg(F.col("is_speech").cast("double")).alias("ratio"))
    return by.filter(F.col("ratio") >= least)


def hopping(samples: Column, width: int, hop: int) -> Column:
    """Windows of `width` samples every `hop`, as an array of structs (start, samples); fewer samples than two windows have none.

    No window hangs over the end, so the last samples may be in none.
    """
    n = F.size(samples)
    starts = F.when(n >= 2 * width, F.sequence(F.lit(0), n - width, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(samples, s + 1, width).alias("samples")))


def window_distances(rows: DataFrame, keys: list[str], samples: str, feature: Callable[[Column], Column], width: int, hop: int, least: int = 3) -> DataFrame:
    """Cosine distances of consecutive windows' features: keys, i, start (of the second window), distance.

    feature turns a window's samples into its vector. Rows with fewer than `least` windows have no distances.
    """
    d = rows.select(*keys, hopping(F.col(samples), width, hop).alias("ws"))
    d = d.filter(F.size("ws") >= least).select(*keys, F.transform("ws", lambda w: F.struct(w["start"], feature(w["samples"]).alias("v"))).alias("ws"))
    pairs = F.zip_with(F.slice("ws", F.lit(1), F.size("ws") - 1), F.slice("ws", F.lit(2), F.size("ws") - 1), lambda a, b: F.struct(b["start"].alias("start"), (1 - S.cosine(a["v"], b["v"])).alias("distance")))
    return d.select(*keys, F.posexplode(pairs).alias("i", "p")).select(*keys, "i", "p.start", "p.distance")
