"""Every registered query against its SQL, streams against batches, and the entry without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from parley.operators import clustering
from parley.plans import catalog
from parley.sources import model
from parley.streaming import live

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if name not in catalog.ORACLES:
        assert len(got)
        return
    want = duck.execute(catalog.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    plain = lambda d: d[cols].astype(object).where(d[cols].notna(), None).astype(str).sort_values(cols).reset_index(drop=True)
    a, b = plain(got), plain(want)
    assert a.equals(b), a.compare(b) if a.shape == b.shape else (len(a), len(b))


def test_quotes_are_verified_as_by_brute_force(spark, sf):
    import difflib

    from parley.functions import text as X

    lines = model.lines(spark, sf)
    said = {}
    for r in lines.select("meeting_id", "position", X.normalise(F.col("text")).alias("hay"), X.tokens(F.col("text")).alias("words")).collect():
        said.setdefault(r["meeting_id"], []).append((r["position"], r["hay"], set(r["words"] or [])))
    got = catalog.quotes_verified(spark, sf).select("*", X.normalise(F.col("quote")).alias("needle"), X.tokens(F.col("quote")).alias("words")).collect()
    assert len(got) == 3 * lines.count() and len({(r["meeting_id"], r["item"]) for r in got}) == len(got)
    ways = set()
    for r in got:
        heard = sorted((x for x in said.get(r["meeting_id"], []) if x[1] and r["needle"]), key=lambda x: x[0])
        inside = [p for p, hay, _ in heard if r["needle"] in hay or hay in r["needle"]]
        words = set(r["words"] or [])
        if inside:
            want, way = (True, inside[0]), "contained"
        else:
            alike = [(difflib.SequenceMatcher(None, r["needle"], hay).ratio(), -p) for p, hay, _ in heard]
            near = max(alike, default=(0.0, 0))
            shared = any(len(words) >= 2 and len(words & w) / len(words) >= 0.65 for _, _, w in heard)
            want, way = (near[0] >= 0.85 or shared, -near[1] if near[0] >= 0.85 else None), "alike" if near[0] >= 0.85 else "shared" if shared else "no"
        assert (r["verified"], r["source_position"]) == want, (r, way)
        ways.add(way)
    assert {"contained", "alike", "no"} <= ways


def test_closed_sessions_stream_as_in_batch(spark, sf, tmp_path):
    events = model.table(spark, sf, "events").repartitionByRange(4, "ts").sortWithinPartitions("ts")
    events.write.parquet(str(tmp_path / "in"))
    stream = live.source(spark, str(tmp_path / "in"), events.schema)
    q = live.sessions(stream, "user_id", "ts").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("user_id", "start", "end", "events").collect()}
    batch = {tuple(r) for r in live.sessions(events, "user_id", "ts").select("user_id", "start", "end", "events").collect()}
    last = events.agg(F.max("ts")).first()[0]
    import datetime

    closed = {r for r in batch if r[2] <= last - datetime.timedelta(hours=1)}
    assert closed <= got <= batch and len(closed) > 100


def drain(query, rows):
    """Run a query with processing-time timeouts, which never ends by itself, until it has read so many rows."""
    import time

    try:
        for _ in range(240):
            if query.exception():
                raise query.exception()
            if sum(p["numInputRows"] for p in query.recentProgress) >= rows:
                return
            time.sleep(0.5)
        raise AssertionError("the stream did not read its rows in two minutes")
    finally:
        query.stop()


@pytest.fixture
def two_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_running_totals_end_at_the_batch_totals(spark, sf, tmp_path, two_partitions):
    lines = model.lines(spark, sf).select("meeting_id", "position", "start_ms", "end_ms")
    lines.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = live.source(spark, str(tmp_path / "in"), lines.schema, per_trigger=1)
    drain(live.running_totals(stream).writeStream.format("memory").queryName("totals").outputMode("update").start(), lines.count())
    got = {r["meeting_id"]: (r["n"], r["ms"]) for r in spark.table("totals").groupBy("meeting_id").agg(F.max("lines").alias("n"), F.max("spoken_ms").alias("ms")).collect()}
    want = {r["meeting_id"]: (r["n"], r["ms"]) for r in lines.groupBy("meeting_id").agg(F.count("*").alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms")).collect()}
    assert got == want


def test_online_labels_stream_as_in_batch(spark, sf, tmp_path, two_partitions):
    segments = catalog._segments(spark, sf).filter("meeting_id < 3").select("meeting_id", "position", "start_sec", "end_sec", "embedding")
    (tmp_path / "all").mkdir()
    for k, part in enumerate(("position < 12", "position >= 12")):  # two files, in order of time, over a restart
        segments.filter(part).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            f.rename(tmp_path / "all" / f"{k}-{f.name}")
        stream = live.online_sessions(live.source(spark, str(tmp_path / "all"), segments.schema))
        drain(stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start(str(tmp_path / "out")), segments.filter(part).count())
    got = {(r["meeting_id"], r["position"]): r["speaker_label"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["meeting_id"], r["position"]): r["speaker_label"] for r in clustering.online_labels(segments).collect()}
    assert got == want


def test_upsert_replaces_by_key(spark, tmp_path):
    from parley.streaming.buckets import BucketTable

    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "meeting_id long, v string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    table = BucketTable(spark, str(tmp_path / "t"), "meeting_id", 8)
    assert table.read() is None
    for _ in range(3):
        stream = live.source(spark, str(tmp_path / "in"), rows.schema)
        live.upsert(stream, str(tmp_path / "t"), "meeting_id", str(tmp_path / "ck"), finish=lambda d: d.withColumn("v", F.upper("v")), buckets=8).start().awaitTermination()
        spark.createDataFrame([(1, "new")], rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert {tuple(r) for r in table.read().collect()} == {(1, "NEW"), (2, "C")}
    m = table.manifest()
    assert m["version"] == 3 and len(set(m["folders"].values())) == 2 and not table.replace(rows, m["batch"])  # a batch again changes nothing
    left = [p for p in (tmp_path / "t").glob("*/key_bucket=*")]
    assert len(left) == 3  # both buckets, and the one that readers of the last version may still read


def test_entry_works_without_the_training_data_operators(tmp_path):
    import shutil

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'talk_time' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True)


def test_frames_are_made_without_a_join(spark, sf):
    from parley.plans import catalog_flow

    # Spark sizes exploded rows as the rows before, so a join could broadcast any number of them
    assert " Join " not in catalog_flow._voiced_frames(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
