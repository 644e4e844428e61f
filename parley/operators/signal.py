"""Audio as columns: PCM and WAV bytes to samples and back, loudness, tones, upload profiles, speech framing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 16_000


def pcm16(data: bytes):
    """16-bit little-endian samples as floats."""
    return np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.float32) / 32768


def wav(data: bytes, rate: int = RATE):
    """A 16-bit WAV file as mono floats at `rate`, by the mean of channels and linear interpolation."""
    import io
    import wave

    with wave.open(io.BytesIO(data)) as w:
        x = pcm16(w.readframes(w.getnframes())).reshape(-1, w.getnchannels()).mean(axis=1)
        old = w.getframerate()
    if old == rate or not len(x):
        return x
    at = np.arange(int(round(len(x) * rate / old))) * old / rate
    return np.interp(at, np.arange(len(x)), x).astype(np.float32)


def to_wav(x, rate: int = RATE) -> bytes:
    """Floats as a mono 16-bit WAV file, clipped."""
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.asarray(x, np.float32), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def second_rms(x, rate: int = RATE):
    """Loudness of each whole second."""
    n = len(x) // rate
    return np.sqrt((np.asarray(x[: n * rate], np.float64).reshape(n, rate) ** 2).mean(axis=1)) if n else np.zeros(0)


def dominant_tone(x, rate: int = RATE, low: float = 50, high: float = 2000, times: float = 3.0):
    """The strongest frequency between low and high if it stands out against their mean, else None."""
    if not len(x):
        return None
    power = np.abs(np.fft.rfft(np.asarray(x, np.float64)))
    freq = np.fft.rfftfreq(len(x), 1 / rate)
    band = (freq >= low) & (freq <= high)
    if not band.any() or power[band].max() < times * power[band].mean():
        return None
    return float(freq[band][power[band].argmax()])


def notch(x, freq: float, rate: int = RATE, q: float = 30.0):
    """A second-order notch filter at one frequency."""
    w = 2 * np.pi * freq / rate
    bw = np.tan(w / q / 2)
    gain = 1 / (1 + bw)
    b, a = gain * np.array([1, -2 * np.cos(w), 1]), np.array([1, -2 * gain * np.cos(w), 2 * gain - 1])
    y, x1, x2, y1, y2 = np.empty(len(x)), 0.0, 0.0, 0.0, 0.0
    for i, v in enumerate(np.asarray(x, np.float64)):
        y[i] = b[0] * v + b[1] * x1 + b[2] * x2 - a[1] * y1 - a[2] * y2
        x1, x2, y1, y2 = v, x1, y[i], y1
    return y.astype(np.float32)


def rolloff(x, rate: int = RATE, share: float = 0.95) -> float:
    """The frequency below which `share` of the magnitude lies."""
    m = np.abs(np.fft.rfft(np.asarray(x, np.float64)))
    c = np.cumsum(m)
    return float(np.fft.rfftfreq(len(x), 1 / rate)[np.searchsorted(c, share * c[-1])]) if len(m) and c[-1] > 0 else 0.0


def level_drift(loud, least: float = 0.005):
    """Decibels between loud and quiet voiced seconds; None under four of them."""
    voiced = np.asarray(loud)[np.asarray(loud) > least]
    if len(voiced) < 4:
        return None
    return float(20 * np.log10(np.percentile(voiced, 90) / np.percentile(voiced, 10)))


def upload_profile(x, rate: int = RATE) -> dict:
    """Thresholds and flags for one file: silence from its quiet seconds, speakers at most by its length, a hum if it is one."""
    loud = second_rms(x, rate)
    seconds = len(x) / rate
    quiet = float(np.percentile(loud, 10)) if len(loud) else 0.0
    return {
        "seconds": seconds, "rms": float(np.sqrt(np.mean(np.square(x, dtype=np.float64)))) if len(x) else 0.0,
        "silence": float(np.clip(1.5 * quiet, 0.0005, 0.002)), "k_max": int(np.clip(seconds // 20 + 2, 4, 20)),
        "flat": bool(len(loud) and loud.mean() >= 0.002 and loud.std() <= 0.005), "tone": dominant_tone(x, rate), "whole_file": seconds <= 60,
    }


def frames(buffer: bytes, chunk: bytes, size: int = 512):
    """(whole frames of `size` samples, bytes left over) of a buffer and the next chunk."""
    data = buffer + chunk
    n = len(data) // (2 * size)
    return pcm16(data[: n * 2 * size]).reshape(n, size), data[n * 2 * size :]


def speech_segments(voiced, frame_ms: float = 32.0, pause_ms: float = 300.0, most_ms: float = 25_000.0):
    """(start_ms, end_ms) of runs of voiced frames: a pause closes one, and so does its length."""
    out, start, last = [], None, None
    for i, v in enumerate(voiced):
        at = i * frame_ms
        if v:
            start = at if start is None else start
            last = at + frame_ms
            if last - start >= most_ms:
                out.append((start, last))
                start = None
        elif start is not None and at + frame_ms - last >= pause_ms:
            out.append((start, last))
            start = None
    if start is not None:
        out.append((start, last))
    return out


def _column(kind: str, work):
    """A Pandas UDF over one column of arrays or bytes; null gives null, or a struct of nulls."""
    fields = [f.split(":")[0].strip() for f in kind[len("struct<") : -1].split(",")] if kind.startswith("struct") else None

    @F.pandas_udf(kind)
    def run(values):
        import pandas as pd

        found = [None if v is None else work(v) for v in values]
        if not fields:
            return pd.Series(found, dtype=object)
        return pd.DataFrame({f: pd.Series([None if r is None else r[f] for r in found], dtype=object) for f in fields})

    return run


def wav_encoded(samples):
    """A column of floats as mono 16-bit WAV files."""
    return _column("binary", to_wav)(samples)


def wav_decoded(content, rate: int = RATE):
    """A column of WAV files as mono floats at `rate`."""
    return _column("array<float>", lambda v: wav(bytes(v), rate))(content)


def pcm_decoded(content):
    """A column of 16-bit little-endian samples as floats."""
    return _column("array<float>", lambda v: pcm16(bytes(v)))(content)


def loudness(samples, rate: int = RATE):
    """The loudness of each whole second of a column of samples."""
    return _column("array<double>", lambda v: second_rms(np.asarray(v), rate))(samples)


def spectrum(samples, rate: int = RATE):
    """Rolloff, dominant tone, level drift, and the loudness left after a notch at the tone."""

    def work(v):
        x = np.asarray(v)
        if not len(x):
            return {"rolloff": None, "tone": None, "drift": None, "notched_rms": 0.0}
        tone = dominant_tone(x, rate, 1, rate / 2)
        rest = notch(x, tone, rate) if tone and tone < rate / 2 else x
        return {"rolloff": rolloff(x, rate), "tone": tone, "drift": level_drift(second_rms(x, rate)), "notched_rms": float(np.sqrt(np.mean(np.square(rest, dtype=np.float64)))) if len(rest) else 0.0}

    return _column("struct<rolloff: double, tone: double, drift: double, notched_rms: double>", work)(samples)


def profiled(samples, rate: int = RATE):
    """upload_profile of a column of samples."""
    return _column("struct<seconds: double, rms: double, silence: double, k_max: int, flat: boolean, tone: double, whole_file: boolean>", lambda v: upload_profile(np.asarray(v), rate))(samples)


def framed(content, size: int = 512):
    """Whole frames in a column of bytes, and how many bytes are left over."""

    def work(v):
        whole, rest = frames(b"", bytes(v), size)
        return {"frames": len(whole), "left_over": len(rest)}

    return _column("struct<frames: int, left_over: int>", work)(content)


def read_audio(spark, path: str) -> DataFrame:
    """Files of 16-bit WAV as (path, samples, seconds, rms). Other containers need a decoder in front."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(pdfs):
        import pandas as pd

        for pdf in pdfs:
            xs = [wav(bytes(c)) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "samples": [x.tolist() for x in xs], "seconds": [len(x) / RATE for x in xs], "rms": [float(np.sqrt(np.mean(np.square(x)))) if len(x) else 0.0 for x in xs]})

    return files.mapInPandas(run, "path string, samples array<float>, seconds double, rms double")


def speech_gate(rows: DataFrame, least_seconds: float = 0.35, rms: float = 0.002) -> DataFrame:
    """Segments long and loud enough to hold speech."""
    return rows.filter((F.col("seconds") >= least_seconds) & (F.col("rms") >= rms))
