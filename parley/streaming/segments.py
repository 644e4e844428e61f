"""Live audio to speech segments, with the open segment and its audio in the state store between batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from parley.operators.segments import FRAME, LONGEST_S, PAUSE_MS, RATE, in_frames

OUT = "start_sec double, end_sec double, cause string, pcm binary"
#: Next chunk, frames so far, speech going on, first frame of the segment, frames that it holds, first silent frame (-1), bytes short of a frame, latest time.
STATE = "next bigint, elapsed bigint, speaking boolean, start bigint, held bigint, silent bigint, rest binary, at bigint"


def loud(threshold: float = 0.01) -> Callable:
    """A stand-in for a speech model: frames (a matrix of samples from -1 to 1) to whether each is at least so loud."""

    def voiced(frames):
        import numpy as np

        return np.sqrt((frames.astype(np.float64) ** 2).mean(axis=1)) >= threshold

    return voiced


class LiveSegments(StatefulProcessor):
    """Chunks of one session (chunk, pcm, last, at) to segments; chunks that come early wait, those that come again are dropped.

    A row with last flushes what is open once all chunks before it are in; so does an idle time of idle_ms by the watermark.
    """

    def __init__(self, key: str, voiced: Callable, frame: int, rate: int, pause_ms: float, longest_s: float, idle_ms: int):
        self.key, self.voiced, self.frame, self.rate, self.idle_ms = key, voiced, frame, rate, idle_ms
        self.pause, self.longest = in_frames(frame, rate, pause_ms, longest_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", STATE)
        self.audio = handle.getListState("audio", "pcm binary")  # of the open segment
        self.early = handle.getMapState("early", "chunk bigint", "pcm binary, last boolean")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        s = list(self.state.get()) if self.state.exists() else [0, 0, False, 0, 0, -1, b"", 0]
        here = pd.concat(list(rows))
        waiting = {int(c): (bytes(p) if p is not None else b"", bool(last)) for c, p, last in zip(here["chunk"], here["pcm"], here["last"], strict=True) if c >= s[0]}
        for k, v in list(self.early.iterator()):
            waiting.setdefault(int(k[0]), (bytes(v[0]), bool(v[1])))
        out, self.fresh, done, was = [], [], False, s[0]
        while s[0] in waiting and not done:
            pcm, done = waiting.pop(s[0])
            s[0] += 1
            self.take(s, pcm, out)
        if done:
            self.flush(s, out, "end")
            self.clear(s)
        else:
            for c, (pcm, last) in waiting.items():
                self.early.updateValue((c,), (pcm, last))
            for c in range(was, s[0]):
                if self.early.containsKey((c,)):
                    self.early.removeKey((c,))
            if self.fresh:
                self.audio.appendValue((b"".join(self.fresh),))
            previous = s[7]
            s[7] = max(s[7], int(here["at"].max().timestamp() * 1000))
            if previous:
                self.handle.deleteTimer(previous + self.idle_ms)
            self.handle.registerTimer(s[7] + self.idle_ms)
            self.state.update(tuple(s))
        yield self.shaped(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        s, out, self.fresh = list(self.state.get()), [], []
        self.flush(s, out, "idle")
        self.clear(None)
        yield self.shaped(key, out)

    def take(self, s: list, pcm: bytes, out: list) -> None:
        """Cut the frames out of what was left over and a chunk, and follow speech through them."""
        import numpy as np

        data = bytes(s[6]) + pcm
        n = len(data) // (2 * self.frame)
        s[6] = data[2 * self.frame * n :]
        if not n:
            return
        frames = np.frombuffer(data, "<i2", n * self.frame).reshape(n, self.frame)
        for i, speech in enumerate(self.voiced(frames.astype(np.float32) / 32768).tolist()):
            at, held = s[1], frames[i].tobytes()
            if s[2]:
                self.fresh.append(held)
                s[4] += 1
                if speech:
                    s[5] = -1
                elif s[5] < 0:
                    s[5] = at
                if s[5] >= 0 and at - s[5] >= self.pause:
                    self.emit(s, out, "pause")
                    s[2], s[5] = False, -1
                elif s[4] >= self.longest:
                    self.emit(s, out, "cut")
                    s[3] = at
            elif speech:
                s[2], s[3], s[4], s[5] = True, at, 1, -1
                self.fresh = [held]
            s[1] += 1

    def emit(self, s: list, out: list, cause: str) -> None:
        before = b"".join(bytes(v[0]) for v in self.audio.get()) if self.audio.exists() else b""
        seconds = self.frame / self.rate
        out.append((s[3] * seconds, s[1] * seconds, cause, before + b"".join(self.fresh)))
        self.audio.clear()
        self.fresh, s[4] = [], 0

    def flush(self, s: list, out: list, cause: str) -> None:
        if s[2] and s[4]:
            self.emit(s, out, cause)

    def clear(self, s: list | None) -> None:
        """Forget a session that has ended."""
        if s is None or s[7]:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        self.state.clear()
        self.audio.clear()
        self.early.clear()

    def shaped(self, key, out: list):
        import pandas as pd

        frame = pd.DataFrame(out, columns=["start_sec", "end_sec", "cause", "pcm"])
        frame.insert(0, self.key, key[0])
        return frame.astype({"start_sec": "float64", "end_sec": "float64"})

    def close(self) -> None:
        pass


def live_segments(
    chunks: DataFrame, key: str = "session", ts: str = "at", voiced: Callable | None = None, frame: int = FRAME, rate: int = RATE, pause_ms: float = PAUSE_MS,
    longest_s: float = LONGEST_S, idle_ms: int = 60_000, late: str = "10 seconds",
) -> DataFrame:
    """Speech segments (key, start_sec, end_sec, cause, pcm) of live sessions, from chunks of 16-bit samples of any length.

    chunks: key, ts, chunk (from 0), pcm, last. A segment ends by a pause, by its length (cut), by the session's last row
    (end) or when no chunk came for idle_ms (idle), so no session loses its last words. Equal to speech_segments over the
    frames of the whole, whatever the chunking. Needs the RocksDB state store.
    """
    kind = chunks.schema[key].dataType.simpleString()
    d = chunks.withColumnRenamed(ts, "at").withWatermark("at", late)
    work = LiveSegments(key, voiced or loud(), frame, rate, pause_ms, longest_s, idle_ms)
    return d.groupBy(key).transformWithStateInPandas(work, f"{key} {kind}, {OUT}", "append", "eventTime")
