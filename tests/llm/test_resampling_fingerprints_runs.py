"""Importance resampling against SQL, fingerprints and periodic runs against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.llm import fingerprints, importance_resampling, oracles, periodic_runs, queries
from tests.llm.test_text_operators import corpus, frame, in_duckdb, same

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# ---------------------------------------------------------------- importance resampling


@pytest.mark.parametrize("chunk", [3_000, 4 << 20])
def test_resampling_matches_sql(spark, monkeypatch, chunk):
    import pandas as pd

    monkeypatch.setattr(importance_resampling, "CHUNK_BYTES", chunk)
    rows = corpus()
    target = pd.DataFrame([(1, "w1 w2 W3 w3 - w7"), (2, None), (3, ""), (4, "È w9 unseen")], columns=["item_id", "text"])
    got = importance_resampling.resample(frame(spark, rows).repartition(3), spark.createDataFrame(target, "item_id bigint, text string"), percent=30)
    a, b = got.toPandas(), in_duckdb(oracles.resampling(percent=30), rows, benchmark=target)
    for c in a.columns:
        a[c], b[c] = a[c].astype("Int64"), b[c].astype("Int64")
    same(a, b)
    assert sorted(a["rank"].dropna()) == list(range(1, 1 + 30 * sum(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r[1] or "").lower())) >= 20 for r in rows) // 100))


def test_resampling_of_longer_ngrams_ties_nulls_and_empty_tables(spark):
    words = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(5, words), (5, words), (None, words), (None, None), (6, "")], "doc_id bigint, text string").withColumn("RANK", F.lit("x"))
    target = spark.createDataFrame([("w1 w2",)], "text string")
    got = importance_resampling.resample(docs, target, percent=100, most=2).collect()
    assert sorted((r["doc_id"] or -1, r["n_features"], r["rank"] or 0) for r in got if r["n_features"]) == sorted(
        (i, 59, k) for i, k in zip((5, 5, -1), (1, 2, 3) if _gumbel("5") >= _gumbel("") else (2, 3, 1))
    )
    assert {(r["n_features"], r["weight"], r["rank"]) for r in got if not r["n_features"]} == {(0, 0, None)}
    assert importance_resampling.resample(docs.limit(0), target).count() == 0
    none = importance_resampling.resample(docs, target.limit(0), percent=50, id_col="doc_id").collect()
    assert len(none) == 5 and sum(r["rank"] is not None for r in none) == 1
    held = importance_resampling.sample(spark.createDataFrame(none, got and "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint"), docs)
    assert held.count() in (1, 2)
    named = importance_resampling.resample(spark.createDataFrame([("b", words), ("a", words)], "name string, body string"), target, 100, id_col="name", text_col="body")
    assert {r["name"] for r in named.collect()} == {"a", "b"}


def _gumbel(doc_id):
    u = (int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
    return int(np.floor(-1000 * np.log(-np.log(u))))


def test_each_distinct_feature_is_one_row_of_the_dictionary(spark):
    a = spark.createDataFrame([("x", 2), ("x", 3), ("y", 1)], "feature string, n bigint")
    b = spark.createDataFrame([("y", 4), ("z", 1)], "feature string, n bigint")
    got = {r["feature"]: (r["s"], r["t"]) for r in importance_resampling.feature_dictionary(a, b, 10).collect()}
    assert got == {"x": (5, 0), "y": (1, 4), "z": (0, 1)}


# ---------------------------------------------------------------- fingerprints


def h64(value, seed=42):
    data = value.encode() if isinstance(value, str) else int(value).to_bytes(8, "little", signed=True) if isinstance(value, (int, np.integer)) else value
    return xxhash.xxh64(data, seed=seed).intdigest()


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def ints(a, j):
    return h64(int(j).to_bytes(4, "little"), h64(int(a).to_bytes(4, "little")))


def brute_fingerprint(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    hashes = []
    if n >= size:
        wh = [signed(h64(w)) for w in words]
        for i in range(n - size + 1):
            seed = 42
            for w in wh[i : i + size]:
                seed = h64(w, seed)
            hashes.append(seed)
    elif n:
        seed = 42
        for w in words:
            seed = h64(w, seed)
        hashes = [seed]
    bins = {}
    for x in hashes:
        j = (x >> 56) ^ 0x80  # the order of signed numbers
        bins[j] = min(bins.get(j, 1 << 64), x)
    own = [bins[j] & 15 if j in bins else None for j in range(256)]
    out = []
    for j in range(256):
        v = own[j]
        for a in range(64):
            if v is None:
                v = own[ints(a, j) & 255]
        if v is None and bins:
            v = min((signed(ints(j, i)) & ~15) | own[i] for i in bins) & 15
        out.append(v or 0)
    return "".join("%x" % v for v in out)


def test_fingerprints_match_brute_force(spark):
    rows = [r for r in corpus() if len(r[1] or "") < 100_000]
    got = {r["doc_id"]: r for r in fingerprints.compare_edited(frame(spark, rows).repartition(3)).withColumn("hexed", fingerprints.as_hex(F.col("fingerprint"))).withColumn("edited_hex", fingerprints.as_hex(F.col("edited_fingerprint"))).collect()}
    down = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for k, (i, text, *_) in enumerate(down):
        text, after = text or "", down[(k + 1) % len(down)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = (brute_fingerprint(t) for t in (text, edited, after))
        assert (got[i]["n_chars"], got[i]["edited"], got[i]["hexed"], got[i]["edited_hex"]) == (len(text), edited, a, b), i

        def like(x, y):
            if not any(set(v) - {"0"} for v in (x, y)):
                return 1.0
            if not all(set(v) - {"0"} for v in (x, y)):
                return 0.0
            return max(0.0, (sum(p == q for p, q in zip(x, y)) / 256 - 1 / 16) / (15 / 16))

        assert got[i]["near_edited"] == pytest.approx(like(a, b)) and got[i]["near_next"] == pytest.approx(like(a, c))


def test_likeness_estimates_jaccard_at_every_length(spark):
    rng = random.Random(5)
    rows, truth = [], {}
    for n in (8, 20, 60, 200, 1000, 5000):
        for _ in range(12):
            words = [str(rng.random()) for _ in range(n)]
            keep = rng.randrange(n)
            other = words[:keep] + [str(rng.random()) for _ in range(n - keep)]
            shingles = [{tuple(w[i : i + 5]) for i in range(n - 4)} for w in (words, other)]
            truth[len(rows)] = (n, len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1]))
            rows.append((len(rows), " ".join(words), " ".join(other)))
    d = spark.createDataFrame(rows, "id int, a string, b string")
    d = fingerprints.with_fingerprint(fingerprints.with_fingerprint(d, F.col("a"), "fa"), F.col("b"), "fb")
    off = {}
    for r in d.select("id", fingerprints.likeness(F.col("fa"), F.col("fb")).alias("near")).collect():
        n, real = truth[r["id"]]
        off.setdefault(n, []).append(r["near"] - real)
    for n, x in off.items():
        assert abs(np.mean(x)) < 0.05 and np.sqrt(np.mean(np.square(x))) < (0.2 if n < 60 else 0.08), (n, x)


def test_the_next_row_is_found_across_blocks_ties_and_nulls(spark):
    ids = [None, None, 7, 7, 7, *range(100, 400, 3), -5]
    rows = [(i, f"t{k}") for k, i in enumerate(ids)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for block_rows, most in ((1, 1 << 18), (7, 1 << 18), (10_000, 1 << 18), (1, 4)):
        got = fingerprints.with_next(d, "doc_id", "text", ["text"], block_rows, most).collect()
        after = {r["text"]: r["next_text"] for r in got}
        by = {f"t{k}": i for k, i in enumerate(ids)}
        assert len(got) == len(rows) and sorted(after.values()) == sorted(after)  # every row follows one
        order, at = [], "t%d" % max(range(len(ids)), key=lambda k: -1e9 if ids[k] is None else ids[k])
        for _ in rows:
            order.append(by[at])
            at = after[at]
        assert order == sorted(order, key=lambda i: (i is None, -(i or 0)))
    one = fingerprints.compare_edited(spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")).collect()[0]
    assert one["edited"] == "a b a" and one["near_next"] == 1.0
    twice = fingerprints.compare_edited(spark.createDataFrame([(1, None), (1, None)], "doc_id bigint, text string")).collect()
    assert [(r["n_chars"], r["edited"], r["near_edited"]) for r in twice] == [(0, "", 1.0)] * 2
    assert fingerprints.compare_edited(d.limit(0)).count() == 0 and fingerprints.fingerprint_documents(d.limit(0)).count() == 0
    clash = fingerprints.fingerprint_documents(frame(spark, corpus()).withColumn("_words", F.lit(1)))
    assert clash.columns == ["doc_id", "n_chars", "fingerprint"] and clash.count() == len(corpus())


# ---------------------------------------------------------------- periodic runs


def brute_runs(words, least=6, repeats=4):
    n, found = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            if length >= max(least, repeats * q):
                found.setdefault((s, length), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=5), st.integers(2, 4), st.integers(0, 8))
def test_runs_of_small_alphabets(texts, repeats, least):
    sizes = np.array([len(t) for t in texts])
    word = np.array([w for t in texts for w in t], np.int64)
    counts, base = periodic_runs.lag_counts(word, sizes, sizes // repeats)
    at = 0
    for i, t in enumerate(texts):
        own = counts[base[i] : base[i] + sizes[i] // repeats + 1]
        assert own[1:].tolist() == [sum(a == b for a, b in zip(t, t[q:])) for q in range(1, len(own))]
        assert sorted(periodic_runs.runs_of(word[at : at + len(t)], own, least, repeats)) == brute_runs(t, least, repeats)
        at += len(t)


@pytest.mark.parametrize("above", [1, 3, 10**6])
def test_heavy_and_light_words_count_alike(monkeypatch, above):
    monkeypatch.setattr(periodic_runs, "heavy_above", lambda n: np.full(len(n), above))
    monkeypatch.setattr(periodic_runs, "HELD", 500)
    rng = np.random.default_rng(1)
    sizes = np.array([700, 0, 3, 1200])
    word = rng.zipf(1.3, sizes.sum()).clip(max=300)
    counts, base = periodic_runs.lag_counts(word, sizes, sizes // 4)
    for t, lo in ((0, 0), (3, 703)):
        w = word[lo : lo + sizes[t]]
        assert counts[base[t] + 1 : base[t] + sizes[t] // 4 + 1].tolist() == [(w[q:] == w[:-q]).sum() for q in range(1, sizes[t] // 4 + 1)]


def test_long_uniform_texts_are_scanned_once():
    word = np.zeros(200_000, np.int64)
    sizes = np.array([len(word)])
    counts, _ = periodic_runs.lag_counts(word, sizes, sizes // 4)
    assert periodic_runs.runs_of(word, counts, 6, 4) == [(0, 200_000, 1)]


def test_runs_query_matches_brute_force(spark, tmp_path):
    import zlib

    rows = [r for r in corpus(n=120) if len(r[1] or "") < 100_000] + [(None, "a b " * 9, "en", "a", 3), (-40, "x " * 50 + "y", "en", "a", 3)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    table = queries.op13_periodic_runs(spark, str(tmp_path)).toPandas()
    a, b = table, in_duckdb(oracles.periodic(), rows)
    for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli"):
        a[c], b[c] = a[c].astype("Int64"), b[c].astype("Int64")
    same(a, b)
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    planted = 0
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            planted += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        listed = "".join("%d,%d,%d\n" % r for r in sorted(runs, key=lambda r: (r[0], r[2])))
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want = (len(runs), *best, None if not runs else 1000 * best[1] // best[2], digest(listed), digest(brute_collapsed(words, runs)))
        assert tuple(got[i][c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) == want, i
    assert planted > 4


def test_runs_pass_rows_through_and_take_odd_tables(spark):
    d = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "a b " * 8)], "doc_id bigint, text string").withColumns({"RUNS": F.lit(1), "start": F.lit("x")})
    got = periodic_runs.find_runs(d)
    assert got.columns == ["doc_id", "text", "start", "n_words", "runs", "collapsed"]
    assert [(r["doc_id"], r["n_words"], len(r["runs"]), r["collapsed"]) for r in got.collect()] == [(1, 0, 0, ""), (1, 0, 0, ""), (None, 0, 0, ""), (2, 16, 1, "a b")]
    assert periodic_runs.find_runs(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(d, repeats=1)
