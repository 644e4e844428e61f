"""Search through the index, nested records, JSON columns, rows that fail, the blocked match of voices."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import insights, intervals, signal, summaries, vectors
from parley.operators.search import search
from parley.operators.search_index import SearchIndex, trigrams
from parley.sources import model, nested, variants
from parley.streaming import failures, live


@pytest.fixture(scope="module")
def indexed(spark, sf, tmp_path_factory):
    odd = spark.createDataFrame([(10**6 + k, 0, t) for k, t in enumerate(["100% sure_thing", "ab", "", None, "मच्छरो की बात", "A\\b_c", "x" * 5000 + " needle"])], "meeting_id bigint, position int, text string")
    lines = model.sayings(spark, sf).unionByName(odd, allowMissingColumns=True)
    more = spark.createDataFrame([(10**6 + k, f"Title {k}", "मच्छर agenda") for k in range(7)], "id bigint, title string, agenda string").withColumn("uploaded_at", F.lit("2030-01-01").cast("timestamp"))
    meetings = model.meetings(spark, sf).unionByName(more, allowMissingColumns=True)
    return SearchIndex.build(meetings, lines, str(tmp_path_factory.mktemp("index") / "i"), buckets=8, spread=2), meetings.cache(), lines.cache()


@pytest.mark.parametrize("tokens", [True, False])
def test_the_index_finds_what_a_scan_finds(indexed, tokens):
    index, meetings, lines = indexed
    rng = random.Random(4)
    texts = [r["text"] for r in lines.select("text").collect() if r["text"]]
    needles = ["मच्छर", "100% s", "_thing", "a\\B", "hello ASHA", "asha hello", "to", "%", "needle", "nowhere to be found", " ", None, "Title 3", "agenda title", "sync"]
    for _ in range(4):
        t = rng.choice(texts)
        at = rng.randrange(len(t))
        needles.append(t[at : at + rng.randrange(3, 12)])
    for needle in needles:
        want = search(meetings, lines, needle, tokens=tokens).collect()
        assert index.search(needle, tokens=tokens).collect() == want, needle
    assert [r["match_count"] for r in index.search("मच्छर", tokens=tokens).collect() if r["id"] == 10**6 + 4] == [1]


def test_a_needle_reads_its_own_buckets_alone(indexed, capsys):
    index = indexed[0]
    index._lists("postings", ["ghel", "gell"]).explain("formatted")
    plan = capsys.readouterr().out
    part = next(x for x in plan.splitlines() if "PartitionFilters" in x)
    assert "bucket" in part and "PushedFilters" in plan and "term" in next(x for x in plan.splitlines() if "PushedFilters" in x)
    assert set(index.rarest(["ghel", "gell"])) == {"ghel", "gell"} and index.rarest(["ghel", "gzzz"]) is None


def test_trigrams_cost_the_length_of_a_text(spark):
    texts = [None, "", "ab", "abc", "aBCabc", "a\nb\r\nc", "मच्छर", "x😀y😀z", "\u2028\u0085..", "".join(map(chr, range(0x4E00, 0x4E00 + 20000))) * 2]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(1)
    t0 = time.monotonic()
    got = {r["id"]: r["g"] for r in d.select("id", trigrams(F.col("text")).alias("g")).collect()}
    assert time.monotonic() - t0 < 10  # splitting the text again at each character took minutes
    for k, text in enumerate(texts):
        low = (text or "").lower()
        assert len(got[k]) == len(set(got[k])) and set(got[k]) == {low[i : i + 3] for i in range(len(low) - 2)}, k


def test_like_texts_share_the_entries_of_a_list(spark, tmp_path):
    n = 5000
    meetings = spark.range(n).select("id", F.lit("Weekly sync").alias("title"), F.lit("same agenda").alias("agenda"), F.lit("2030-01-01").cast("timestamp").alias("uploaded_at"), F.lit("Completed").alias("status"), F.lit(None).cast("timestamp").alias("deleted_at"))
    lines = spark.range(n).select(F.pmod("id", F.lit(7)).alias("meeting_id"), F.col("id").cast("int").alias("position"), F.lit("A").alias("speaker"), F.lit("en").alias("language"), F.when(F.col("id") % 9 != 0, "so be it").otherwise("weekly notes").alias("text"))
    index = SearchIndex.build(meetings, lines, str(tmp_path / "i"), buckets=4, spread=2)
    entries = index._read("postings").filter("term IN ('gwee', 'tweekly')").collect()
    assert len(entries) < n / 10 and index._read("frequencies").filter("term = 'gwee'").first()["n"] == n + 556
    for needle in ("weekly", "SAME weekly", "kly n", "sync same"):
        for tokens in (True, False):
            assert index.search(needle, tokens=tokens).collect() == search(meetings, lines, needle, tokens=tokens).collect(), needle


RECORD = {
    "id": "m1", "title": "Weekly", "agenda": None, "fileName": "a.wav", "fileSizeBytes": 12, "uploadedAtISO": "2024-01-02T03:04:05Z", "status": "Completed", "durationSeconds": 61.5,
    "languages": [{"code": "en", "name": "English", "seconds": 40.0, "pct": 66.0}], "speakerStats": [{"name": "Asha", "seconds": 40.0, "time": "0:40", "pct": 66.0, "color": "c"}],
    "transcript": [{"start_sec": 0.0, "end_sec": 4.5, "speaker": "Asha", "text": "hello", "is_overlap": False}, {"start_sec": 5.0, "end_sec": 9.0, "speaker": "Ravi", "text": "नमस्ते", "is_overlap": True, "candidate_speakers": ["Asha", "Ravi"]}],
    "decisions": [], "actionItems": [{"title": "Ship", "assignee": "Ravi", "due": None, "quote": "ship it"}], "keywords": ["b", "a", "b"], "unknownField": {"x": 1},
}


def test_nested_records_come_back_as_they_went_in(spark):
    raw = [json.dumps(RECORD, ensure_ascii=False), json.dumps({"id": "m2"}), json.dumps({"title": "no id"}), "[1", "", None, json.dumps(RECORD, ensure_ascii=False)]
    tables = nested.shred(nested.parse(spark.createDataFrame([(r,) for r in raw], "value string")))
    assert set(tables) == {"meetings", "languages", "speaker_stats", "transcript", "decisions", "action_items", "keywords"}
    assert sorted(r["id"] for r in tables["meetings"].collect()) == ["m1", "m2"] and tables["meetings"].columns[:4] == ["id", "title", "agenda", "file_name"]
    assert [(r["position"], r["value"]) for r in tables["keywords"].orderBy("position").collect()] == [(0, "b"), (1, "a"), (2, "b")]
    assert tables["decisions"].count() == 0 and tables["transcript"].count() == 2
    again = {r["id"]: json.loads(r["value"]) for r in nested.assemble(tables).collect()}
    full = again["m1"]
    for name in ("languages", "speakerStats", "transcript", "keywords"):
        assert full[name] == RECORD[name]
    assert full["actionItems"] == [{k: v for k, v in RECORD["actionItems"][0].items() if v is not None}] and again["m2"] == {"id": "m2"}
    assert [nested.snake(n) for n in ("uploadedAtISO", "fileSizeBytes", "id", "HTTPServer")] == ["uploaded_at_iso", "file_size_bytes", "id", "http_server"]
    lost = tables | {"keywords": tables["keywords"].filter("position < 1"), "transcript": tables["transcript"].limit(0)}
    assert {tuple(r) for r in nested.child_differences(tables, lost, ["keywords", "transcript", "languages"]).collect()} == {("m1", "keywords", 3, 1), ("m1", "transcript", 2, 0)}


def test_variant_profiles_of_every_shape(spark):
    texts = {"a": '{"centroid": [1, 0.5], "sample_count": 7}', "b": "[0.25, 2]", "c": '{"centroid": [1]}', "d": "{", "e": '{"centroid": "x"}', "f": '["a", 1]', "g": "[1, null]", "h": None, "i": "[]"}
    d = spark.createDataFrame(list(texts.items()), "name string, text string").select("name", variants.decoded(F.col("text")).alias("profile"))
    got = {r["name"]: (list(r["centroid"]), r["sample_count"]) for r in variants.profiles(d).collect()}
    assert got == {"a": ([1.0, 0.5], 7), "b": ([0.25, 2.0], 1), "c": ([1.0], 1), "i": ([], 1)}
    back = d.filter("name = 'a'").select(variants.encoded(F.col("profile")).alias("t")).first()["t"]
    assert json.loads(back) == json.loads(texts["a"])


def checked(v):
    if v is None or len(v) != 2 or any(x != x for x in v):
        raise ValueError("bad vector")
    return v[0] / v[1]


def test_bad_rows_go_to_their_own_sink_and_faults_stop_the_stream(spark, tmp_path):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [9.0, 3.0])]
    spark.createDataFrame(rows, "id bigint, v array<double>").repartition(2).write.parquet(str(tmp_path / "in"))
    schema = spark.createDataFrame([], "id bigint, v array<double>").schema
    stream = lambda: failures.with_errors(live.source(spark, str(tmp_path / "in"), schema), checked, ["v"], "double")
    start = lambda: failures.split_sinks(stream(), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "ck")).start()
    start().awaitTermination()
    assert {(r["id"], r["value"]) for r in spark.read.parquet(str(tmp_path / "good")).collect()} == {(1, 0.5), (5, 3.0)}
    assert {(r["id"], r["error"]) for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {(k, "ValueError: bad vector") for k in (2, 3, 4)}
    spark.createDataFrame([(6, [1.0, 0.0])], "id bigint, v array<double>").write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="ZeroDivisionError"):
        start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2


def test_blocks_of_profiles_give_the_same_match(spark):
    rng = np.random.default_rng(2)
    q = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(40, 6)))] + [(90, [0.0] * 6), (91, None), (92, [1.0])]
    p = [(f"p{k}", v.tolist()) for k, v in enumerate(rng.normal(size=(17, 6)))]
    p += [("twin", p[3][1]), ("zero", [0.0] * 6)]
    q += [(70, p[3][1]), (71, p[5][1])]
    queries = spark.createDataFrame(q, "vec_id bigint, embedding array<double>")
    profiles = spark.createDataFrame(p, "name string, centroid array<double>")
    whole = vectors.match_profiles(queries, profiles).collect()
    want = {r["vec_id"]: tuple(r) for r in vectors.match_voice(vectors.rank_profiles(queries.filter("vec_id NOT IN (91, 92)"), profiles)).collect()}
    assert {r["vec_id"]: tuple(r) for r in whole if r["vec_id"] not in (91, 92)} == want
    assert {tuple(r) for r in vectors.match_profiles(queries, profiles, block=4).collect()} == {tuple(r) for r in whole}
    assert want[70][1] == "Unknown" and want[71][1] == "p5" and vectors.match_profiles(queries, profiles.limit(0)).count() == 0
    plan = vectors.match_profiles(queries, profiles)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan and "Window" not in plan


def test_hopping_windows_start_where_they_should(spark):
    d = spark.createDataFrame([(n, [float(x) for x in range(n)]) for n in (0, 5, 11, 12, 13, 40)], "n int, x array<double>")
    got = {r["n"]: [w["start"] for w in r["w"]] for r in d.select("n", intervals.hopping(F.col("x"), 6, 5).alias("w")).collect()}
    assert got == {n: [] if n < 12 else list(range(0, n - 5, 5)) for n in (0, 5, 11, 12, 13, 40)}
    far = intervals.window_distances(d, ["n"], "x", lambda x: x, 6, 5)
    assert {r["n"] for r in far.collect()} == {40}  # fewer than three windows have no distances


def test_one_model_a_worker_and_no_answer_drops_out(spark):
    made = spark.sparkContext.accumulator(0)

    def make():
        made.add(1)
        return lambda prompts: np.array(["" if "mute" in p else p.upper()[:4] for p in prompts], object)

    d = spark.createDataFrame([(1, 0, "alpha"), (1, 1, "mute"), (2, 1, "second"), (2, 0, "first"), (3, 0, "mute"), (4, 0, None)], "meeting_id bigint, summary_window int, content string").coalesce(1)
    got = {r["meeting_id"]: (r["summary"], r["parts"]) for r in summaries.map_reduce(d, make, lambda: lambda p: np.array([x.replace("\n\n", "+") for x in p], object)).collect()}
    assert got == {1: ("ALPH", 1), 2: ("FIRS+SECO", 2), 3: (None, 0), 4: (None, 0)}
    silent = summaries.map_reduce(d, make, lambda: lambda p: np.array([""] * len(p), object)).filter("meeting_id = 2").first()
    assert silent["summary"] == "FIRS SECO"


def test_sound_columns_take_nulls_and_empty_arrays(spark):
    d = spark.createDataFrame([(0, None, None), (1, [], b""), (2, [0.5, -0.5] * 64, b"\x01\x00" * 40)], "k int, x array<float>, b binary")
    d = d.select("k", signal.spectrum("x").alias("s"), signal.profiled("x").alias("p"), signal.framed("b", 32).alias("f"), signal.loudness("x", 32).alias("l"), signal.pcm_decoded("b").alias("pcm"))
    got = {r["k"]: r for r in d.collect()}
    assert got[0]["f"]["frames"] is None and got[0]["p"]["seconds"] is None and got[0]["s"]["tone"] is None and got[0]["l"] is None and got[0]["pcm"] is None
    assert got[1]["f"] == (0, 0) and got[1]["p"]["seconds"] == 0.0 and got[1]["s"]["notched_rms"] == 0.0 and got[1]["l"] == []
    assert got[2]["f"] == (1, 16) and len(got[2]["l"]) == 4 and got[2]["s"]["rolloff"] is not None


def test_owners_are_sought_in_the_order_of_the_lines(spark):
    said = [(1, i, i * 1000, i * 1000 + 900, "S0", "Asha", t) for i, t in enumerate(["the report is for Meera", "Joshi to write by friday", "nothing more"])]
    lines = spark.createDataFrame(said, "meeting_id long, position int, start_ms long, end_ms long, speaker_label string, speaker string, text string").withColumn("color", F.lit("c")).repartition(3)
    proposed = spark.createDataFrame([(1, 0, "Write the report", "Meera Joshi", None, "the report is for Meera")], "meeting_id long, item int, title string, owner string, due string, quote string")
    assert [r["assignee"] for r in insights.collect_actions(proposed, lines).collect()] == ["Meera Joshi"]
