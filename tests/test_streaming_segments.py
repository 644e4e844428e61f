"""Live segments: the stream against the batch form, cuts, flushes, chunking and restarts."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parley.operators import segments
from parley.streaming import live
from parley.streaming.segments import live_segments, loud

FRAME, RATE = 32, 1000  # 32 ms frames, as in use, of fewer samples
CHUNK = "session bigint, at timestamp, chunk bigint, pcm binary, last boolean"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset(name)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def brute(voiced, pause, longest):
    """(start, stop, cause) frame by frame, a voice detector that ends after `pause` silent frames past the first."""
    out, on, start, held, silent = [], False, 0, 0, None
    for i, v in enumerate(voiced):
        event = None
        if v:
            silent = None
            event = "start" if not on else None
        elif on:
            silent = i if silent is None else silent
            event = "end" if i - silent >= pause else None
        held += on
        if event == "start":
            on, start, held = True, i, 1
        elif event == "end":
            out.append((start, i, "pause"))
            on, silent = False, None
        elif on and held >= longest:
            out.append((start, i, "cut"))
            start, held = i, 0
    if on and held:
        out.append((start, len(voiced), "end"))
    return out


def speech(rng, n):
    voiced = np.zeros(n, bool)
    at = 0
    while at < n:
        run = int(rng.integers(1, 60))
        voiced[at : at + run] = rng.random() < 0.6
        at += run
    return voiced


def test_segments_of_frames_match_brute_force(spark):
    rng = np.random.default_rng(3)
    series = {k: speech(rng, int(rng.integers(1, 400))) for k in range(60)} | {60: np.ones(300, bool), 61: np.zeros(5, bool), 62: np.ones(30, bool), 63: np.ones(20, bool), 64: np.ones(39, bool)}
    frames = spark.createDataFrame(pd.DataFrame([(k, i, bool(v)) for k, vs in series.items() for i, v in enumerate(vs)], columns=["session", "i", "voiced"]))
    got = {}
    for r in segments.speech_segments(frames, pause=3, longest=20).collect():
        got.setdefault(r["session"], []).append((r["start"], r["stop"], r["cause"]))
    for k, vs in series.items():
        assert sorted(got.get(k, [])) == brute(vs, 3, 20), k
    assert segments.in_frames() == (10, 782)


def sound(voiced):
    wave = np.tile(np.array([1, -1], np.int16), FRAME // 2)
    return b"".join((wave * (8000 if v else 3)).astype("<i2").tobytes() for v in voiced)


def chunked(rng, k, voiced, last=True):
    data, rows, at = sound(voiced) + b"\x01\x02\x03", [], 0
    while at < len(data):
        size = int(rng.integers(1, 4000))
        rows.append([k, datetime(2024, 1, 1) + timedelta(seconds=len(rows)), len(rows), data[at : at + size], False])
        at += size
    if last:
        rows.append([k, rows[-1][1], len(rows), b"", True])
    return rows


def run(spark, rows, folder, batches, tmp_path, **kind):
    """Write rows as so many files, run the stream to its end, and return its segments."""
    schema = CHUNK
    for part in np.array_split(np.arange(len(rows)), batches):
        spark.createDataFrame([tuple(rows[i]) for i in part], schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = live.source(spark, str(folder), spark.createDataFrame([], schema).schema, per_trigger=1)
    found = live_segments(stream, voiced=loud(0.05), frame=FRAME, rate=RATE, pause_ms=100, longest_s=1.28, **kind)
    found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def as_frames(d):
    got = {}
    for r in d.collect():
        got.setdefault(r["session"], []).append((round(r["start_sec"] * RATE / FRAME), round(r["end_sec"] * RATE / FRAME), r["cause"], len(r["pcm"]) // (2 * FRAME)))
    return {k: sorted(v) for k, v in got.items()}


def test_live_segments_equal_the_batch_form_over_restarts(spark, rocks, tmp_path):
    """Chunks of any size, out of order within a batch and repeated; the stream is stopped and goes on from its checkpoint."""
    rng = np.random.default_rng(5)
    series = {k: speech(rng, 260) for k in range(4)} | {4: np.ones(150, bool)}
    rows = {k: chunked(rng, k, v) for k, v in series.items()}
    pause, longest = segments.in_frames(FRAME, RATE, 100, 1.28)
    first = [r for k in rows for r in rows[k][: len(rows[k]) // 2]]
    rest = [r for k in rows for r in rows[k][len(rows[k]) // 2 :]]
    first = [first[i] for i in rng.permutation(len(first))]
    run(spark, first + first[:3], tmp_path / "in", 2, tmp_path)
    got = as_frames(run(spark, rest, tmp_path / "in", 2, tmp_path))
    for k, voiced in series.items():
        assert [x[:3] for x in got.get(k, [])] == brute(voiced, pause, longest), k
        frames = spark.createDataFrame([(k, i, bool(v)) for i, v in enumerate(voiced)], "session bigint, i bigint, voiced boolean")
        assert sorted((r["start"], r["stop"], r["cause"]) for r in segments.speech_segments(frames, pause=pause, longest=longest).collect()) == brute(voiced, pause, longest)
    assert any(x[2] == "cut" for v in got.values() for x in v) and all(x[3] > 0 for v in got.values() for x in v)
    held = [x for x in got[4] if x[2] == "cut"]
    assert [x[3] for x in held] == [longest] * len(held)  # each cut holds the longest number of frames


def test_an_idle_session_is_flushed_by_the_watermark(spark, rocks, tmp_path):
    rng = np.random.default_rng(8)
    talk = chunked(rng, 1, np.ones(30, bool), last=False)
    later = [[2, datetime(2024, 1, 1, 1) + timedelta(seconds=k), k, sound([False]), False] for k in range(2)]
    got = as_frames(run(spark, talk + later, tmp_path / "in", 2, tmp_path, idle_ms=60_000))
    assert got == {1: [(0, 30, "idle", 30)]}
