"""Live sessions as Structured Streaming: sessions, running talk time, online labels, and the closing batch pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley.operators.clustering import Limits, Online


def source(spark, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; NTZ timestamps become instants."""
    reader = spark.readStream.schema(schema)
    df = (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)
    return df.withColumns({c: F.col(c).cast("timestamp") for c, k in df.dtypes if k == "timestamp_ntz"})


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows per key: opened by an event, closed by a gap. Works on streams and on batches alike."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("total")).select(
        key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "total"
    )


def tumbling(events: DataFrame, ts: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Event counts by fixed windows and type."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "event_type", "events")


def running_totals(lines: DataFrame, key: str = "meeting_id", idle_ms: int = 3_600_000) -> DataFrame:
    """After every batch, each touched session's lines and speech so far; idle sessions are dropped, so state does not grow.

    The timeout runs on processing time, so the query goes on until it is stopped: do not start it with availableNow.
    """

    def step(k, pdfs: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        n, ms = state.get if state.exists else (0, 0)
        for pdf in pdfs:
            n, ms = n + len(pdf), ms + int((pdf["end_ms"] - pdf["start_ms"]).clip(lower=0).sum())
        state.update((n, ms))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: [k[0]], "lines": [n], "spoken_ms": [ms]})

    return lines.groupBy(key).applyInPandasWithState(step, f"{key} bigint, lines bigint, spoken_ms bigint", "lines bigint, spoken_ms bigint", "update", GroupStateTimeout.ProcessingTimeTimeout)


def online_sessions(segments: DataFrame, key: str = "meeting_id", limits: Limits = Limits(), idle_ms: int = 3_600_000) -> DataFrame:
    """Voices labelled as they arrive: the clustering state of each session lives in the state store between batches.

    Within a batch segments run in order of start; a batch is emitted once and not rewritten. A failing
    segment is labelled null and counted as failed, and the session goes on.
    """
    import pickle

    def step(k, pdfs: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        live = Online.resume(limits, pickle.loads(bytes(state.get[0]))) if state.exists else Online(limits)
        rows = pd.concat(list(pdfs)).sort_values(["start_sec", "position"])
        out = []
        for r in rows.itertuples(index=False):
            if r.embedding is None or len(r.embedding) == 0:
                out.append((k[0], r.position, None, True))
                continue
            out.append((k[0], r.position, live.add(r.start_sec, r.end_sec, r.embedding)[0], False))
        state.update((pickle.dumps(live.state()),))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[key, "position", "speaker_label", "failed"])

    return segments.groupBy(key).applyInPandasWithState(step, f"{key} bigint, position int, speaker_label string, failed boolean", "live binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def upsert(stream: DataFrame, path: str, key: str, checkpoint: str, finish: Callable[[DataFrame], DataFrame] | None = None, buckets: int = 64):
    """Each batch replaces its keys' rows in the bucketed table at path, once; `finish` turns a batch into the rows to store.

    Only the buckets that a batch touches are read and rewritten. finish sees whole sessions if the batch holds them, and so
    may recompute what closing a session changes.
    """
    from parley.streaming.buckets import BucketTable

    def write(batch: DataFrame, batch_id: int) -> None:
        BucketTable(batch.sparkSession, path, key, buckets).replace(finish(batch) if finish else batch, batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
