"""Speech segments from voiced frames: opened by speech, closed by a pause, cut when they grow too long, flushed at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Samples a second, samples of a frame, the pause that ends a segment and the longest segment.
RATE, FRAME, PAUSE_MS, LONGEST_S = 16_000, 512, 300, 25.0


def in_frames(frame: int = FRAME, rate: int = RATE, pause_ms: float = PAUSE_MS, longest_s: float = LONGEST_S) -> tuple[int, int]:
    """(silent frames after the first that end a segment, frames that a segment holds at most)."""
    return -(-int(pause_ms * rate / 1000) // frame), -(-int(longest_s * rate) // frame)


def speech_segments(frames: DataFrame, session: str = "session", pause: int = 10, longest: int = 782) -> DataFrame:
    """Segments (session, start, stop, cause) in frames, from one row (session, i, voiced) for each frame from 0 on.

    A segment opens at a voiced frame and ends `pause` frames after the first of that many and one more silent ones. One that
    holds `longest` frames is cut at the last of these, where the next begins; the first holds its opening frame, later
    ones the frames after their cut. What is open after the last frame is flushed. cause: pause, cut or end.
    """
    by = Window.partitionBy(session).orderBy("i")
    n = frames.groupBy(session).agg((F.max("i") + 1).alias("n"))
    voiced = frames.filter("voiced").withColumn("fresh", F.coalesce(F.col("i") - F.lag("i").over(by) >= pause + 2, F.lit(True)).cast("int"))
    voiced = voiced.withColumn("island", F.sum("fresh").over(by))
    spans = voiced.groupBy(session, "island").agg(F.min("i").alias("first"), F.max("i").alias("last")).join(n, session)
    end = F.col("last") + 1 + pause
    spans = spans.withColumn("closed", end < F.col("n")).withColumn("until", F.least(end, F.col("n")))
    # cuts lie before the end: at first + longest - 1 and every `longest` frames after that
    cuts = F.when(F.col("first") + longest - 1 < F.col("until"), F.sequence(F.col("first") + longest - 1, F.col("until") - 1, F.lit(longest).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    spans = spans.select(session, "until", "closed", F.concat(F.array("first"), cuts, F.array("until")).alias("edges"))
    pieces = spans.select(session, "closed", F.size("edges").alias("m"), "until", F.posexplode(F.slice("edges", F.lit(1), F.size("edges") - 1)).alias("k", "start"), "edges")
    pieces = pieces.withColumn("stop", F.get("edges", F.col("k") + 1)).withColumn("final", F.col("k") == F.col("m") - 2)
    # a cut at the very last frame leaves nothing to flush
    empty = F.col("final") & ~F.col("closed") & (F.col("k") > 0) & (F.col("stop") - F.col("start") <= 1)
    cause = F.when(~F.col("final"), "cut").when(F.col("closed"), "pause").otherwise("end")
    return pieces.filter(~empty).select(session, "start", "stop", cause.alias("cause"))
