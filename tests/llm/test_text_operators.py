"""Substring dedup, quality rules, decontamination, SimHash and sharding against brute force and SQL."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parley.llm import components, decontamination, oracles, quality_rules, sharding, simhash, substring_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(seed=3, n=60):
    """Random texts over few words with copies, shared passages and all the odd cases."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(400)
    passage = [[word() for _ in range(rng.randrange(20, 60))] for _ in range(5)]
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.choice([0, 1, 5, 19, 20, 21, 60, 300]))]
        if rng.random() < 0.4:
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passage)
        if rng.random() < 0.1:
            words = words[:25] * 4
        text = "".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in words)
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(text)))
    rows += [(n, None, "en", "a", None), (n + 1, "", None, None, 0), (n + 2, " \n\t ", "en", "b", 4), (n + 3, rows[3][1], "en", "a", 5), (n + 4, rows[3][1], "de", "a", 5)]
    rows += [(n + 5, "ÀÉ über ½   ▁x \U0001f600 " * 9, "fr", "a", 9), (n + 6, "\x0b\x0cx\x1cy " * 30, "fr", "a", 9)]
    rows.append((n + 7, " ".join("long%d" % (k % 7000) for k in range(30_000)), "en", "a", 1))
    return rows


def shorter(rows):
    """The rows without the very long text, over which the SQL takes minutes."""
    return [r for r in rows if len(r[1] or "") < 100_000]


def frame(spark, rows):
    """The rows with further columns whose names clash with results."""
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("kept", "SCORE", "shard", "n_items", "fp", "component_id")})


def in_duckdb(sql, rows, **tables):
    import pandas as pd

    con = duckdb.connect()
    docs = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"})
    con.register("documents_", docs)
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, lang::VARCHAR AS lang, source::VARCHAR AS source FROM documents_")
    for name, t in tables.items():
        con.register(f"{name}_", t)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_")
    return con.execute(sql).df()


def same(a, b):
    cols = sorted(b.columns)
    assert sorted(a.columns) == cols
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert a.equals(b), a.compare(b) if a.shape == b.shape else (len(a), len(b))


def brute_removed(rows, window=20):
    """doc_id -> (words, mask of removed words), windows judged on the input."""
    words = {}
    for i, t, *_ in rows:
        words[i] = (t or "").encode().split()
    seen, gone = {}, {i: [False] * len(w) for i, w in words.items()}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            key = tuple(words[i][s : s + window])
            if key in seen:
                gone[i][s : s + window] = [True] * window
            else:
                seen[key] = (i, s)
    return words, gone


@pytest.mark.parametrize("chunk", [2_000, 4 << 20])
def test_substring_dedup_matches_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk)
    rows = corpus()
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    words, gone = brute_removed(rows)
    assert set(got) == set(words)
    for i, w in words.items():
        kept = b" ".join(x for x, g in zip(w, gone[i]) if not g).decode()
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"]) == (len(w), sum(gone[i]), kept)
    assert got[60]["lang"] == "en" and got[60]["text"] is None  # other columns pass through


def test_substring_dedup_ties_nulls_and_empty_tables(spark):
    text = " ".join(f"t{k}" for k in range(30))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text, "en", "a", 1), (None, text, "en", "a", 1)]
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, 0), (-1, 0), (1, 30), (1, 30)]  # null ids come first; equal rows are not earlier than each other
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = substring_dedup.remove_repeats(frame(spark, rows).withColumn("N_Words", F.lit(1)))
    assert [c.lower() for c in clash.columns].count("n_words") == 1 and clash.agg(F.sum("n_words")).first()[0] == 120
    words = spark.createDataFrame([("b", text), ("a", text), (None, text), ("c", "short")], "doc_id string, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(words).collect()}
    assert got == {None: 0, "a": 30, "b": 30, "c": 0}
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(words.filter("doc_id IS NOT NULL")).collect()}
    assert got == {"a": 0, "b": 30, "c": 0}


def test_chunks_of_one_task_share_a_table_bucket(spark):
    keys = [5, -7, 2**61 + 12345, 0, 99]
    got = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", F.pmod(F.hash("k"), F.lit(51)).alias("b")).collect()
    assert [substring_dedup.table_bucket(r["k"], 51) for r in got] == [r["b"] for r in got]


def test_windows_whose_filters_agree_are_told_apart(spark, monkeypatch):
    """With the hash of every window made equal, its digest still decides."""
    from parley.llm import wordhash

    texts = [(i, " ".join(f"u{i}_{k}" for k in range(25))) for i in range(3)] + [(9, " ".join(f"u1_{k}" for k in range(25)))]
    real = wordhash.window_hashes
    monkeypatch.setattr(substring_dedup, "window_hashes", lambda *a: (real(*a)[0] * np.uint64(0), *real(*a)[1:]))
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 9: 25}


@pytest.mark.parametrize("letters", [1024, 2048])
def test_words_whose_polynomials_agree_are_told_apart(spark, letters):
    """Thue-Morse words and their complements agree in every polynomial modulo 2^64, in one word and as an order of words."""
    bits = [bin(k).count("1") % 2 for k in range(letters)]
    word = lambda flip: "".join("ab"[b ^ flip] for b in bits)
    order = lambda flip: " ".join(("red", "blue")[b ^ flip] for b in bits[:16])
    same_ = " ".join(f"w{k}" for k in range(19))
    texts = [(1, f"{same_} {word(0)}"), (2, f"{same_} {word(1)}"), (3, f"{order(0)} a b c d"), (4, f"{order(1)} a b c d"), (5, f"{same_} {word(1)}")]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 20}


def test_quality_rules_match_sql(spark):
    rows = shorter(corpus(5, 250))
    rows += [(900 + k, "Some plain words in a line of text that goes on for twenty words or more and then ends at last here now " + "#$% " * (k % 40), "en", "a", 1) for k in range(220)]
    rows.append(rows[0])
    got = quality_rules.judge_quality(frame(spark, rows)).toPandas()
    same(got, in_duckdb(oracles.quality(), rows))
    assert got["kept"].any() and not got["kept"].all()
    # two groups of one language whose own fences differ: the same text passes in one and not in the other
    words = lambda n: " ".join(chr(97 + k) * (n - 1) + "z" for k in range(24))
    two = [(k, words(4 + k % 2), "xx", "short", 1) for k in range(400)] + [(500 + k, words(20 + k % 9), "xx", "long", 1) for k in range(400)]
    two += [(900, words(24), "xx", "short", 1), (901, words(24), "xx", "long", 1)]
    verdict = quality_rules.judge_quality(spark.createDataFrame(two, SCHEMA)).toPandas()
    same(verdict, in_duckdb(oracles.quality(), two))
    assert dict(zip(verdict.doc_id, verdict.kept))[901] and not dict(zip(verdict.doc_id, verdict.kept))[900]
    assert quality_rules.judge_quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_thresholds_follow_the_spread_of_their_group(spark):
    """Symbols, which most texts lack: a group whose tail holds many allows more than one whose tail holds few."""
    base = " ".join(f"word{k}x" for k in range(30))
    rows = [(i, base + " " + "#" * (0 if i % 100 >= 12 else n), "en", src, 1) for src, n, lo in (("plain", 3, 0), ("code", 40, 3000)) for i in range(lo, lo + 2000)]
    rows += [(9000, base + " " + "#" * 30, "en", "plain", 1), (9001, base + " " + "#" * 30, "en", "code", 1)]
    got = quality_rules.judge_quality(spark.createDataFrame(rows, SCHEMA)).toPandas()
    same(got, in_duckdb(oracles.quality(), rows))
    kept = dict(zip(got.doc_id, got.kept))
    assert not kept[9000] and kept[9001] and kept[0] and kept[50]
    metrics = quality_rules.with_ratios(quality_rules.measure(spark.createDataFrame(rows, SCHEMA)))
    hi = {(r["source"], r["metric"]): (r["hi"], r["hi_least"]) for r in quality_rules.limits(quality_rules.blended(quality_rules.sketches(metrics, ["lang", "source"]))).collect()}
    assert hi["code", "symbol_ratio"][0] > 2 * hi["plain", "symbol_ratio"][0] and not hi["plain", "symbol_ratio"][1]


def test_sketches_merge_and_bound_the_error(spark):
    values = [random.Random(1).lognormvariate(-2, 2) for _ in range(5000)]
    df = spark.createDataFrame([(v, "a" if k % 3 else "b") for k, v in enumerate(values)], "mean_word double, source string")
    df = df.withColumns({"n_words": F.lit(1), "lang": F.lit("en"), "symbol_ratio": F.lit(0.0), "dup_line_ratio": F.lit(0.0), "repeat_ratio": F.lit(0.0)})
    parts = quality_rules.sketches(df, ["lang", "source"])
    merged = {tuple(r) for r in quality_rules.merge(parts, []).collect()}
    assert merged == {tuple(r) for r in quality_rules.sketches(df, []).collect()}
    q = quality_rules.fences(quality_rules.quantiles(quality_rules.merge(parts, []), []), []).first()
    q3 = np.quantile(values, 0.75)
    q1 = np.quantile(values, 0.25)
    want = q3 + quality_rules.FENCE * (q3 - q1)
    assert abs(q["hi_mean_word"] - want) <= 0.05 * want


def test_decontamination_matches_sql(spark):
    import pandas as pd

    rng = random.Random(9)
    rows = shorter(corpus(7, 80))
    items = [(k, " ".join("w%d" % rng.randrange(400) for _ in range(rng.choice([1, 2, 3, 5, 12, 13, 14, 40])))) for k in range(30)]
    items += [(30, None), (31, " --- "), (32, "W1, w2; W3"), (33, items[3][1]), (3, "again w9 w8")]
    for k in range(20):  # plant items, with other case and punctuation
        words = (rows[k][1] or "").split()
        words[len(words) // 2 : len(words) // 2] = [items[k][1].upper().replace(" ", "-!")] if k % 2 else [items[k][1]]
        rows[k] = (k, " ".join(words), *rows[k][2:])
    rows.append(rows[1])
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("n_words", F.lit(1))
    got = decontamination.decontaminate(frame(spark, rows), bench)
    want = in_duckdb(oracles.decontamination(), rows, benchmark=pd.DataFrame(items, columns=["item_id", "text"]))
    same(got.toPandas(), want)
    assert want["contaminated"].any()
    rows.append((9999, corpus()[-1][1] + " " + items[11][1], "en", "a", 1))
    full = {tuple(r) for r in decontamination.contaminated_spans(frame(spark, rows), bench)[1].collect()}
    bound = {tuple(r) for r in decontamination.contaminated_spans(frame(spark, rows), bench, max_broadcast=0)[1].collect()}  # shuffled joins
    assert full == bound and any(r[0] == 9999 and r[2] == 30_000 for r in full)


def test_bloom_filter_passes_every_token_and_few_others(spark):
    tokens = spark.range(3000).select(F.xxhash64("id").alias("token"))
    for most, share in ((1 << 26, 0.01), (1 << 12, 1.0)):
        bits, n = decontamination.bloom(tokens, most)
        row = [b & (2**64 - 1) for b in bits.first()["bits"]]
        assert len(row) == n
        test = lambda t: all(row[(h >> 6) & (n - 1)] >> (h & 63) & 1 for h in (t & (2**64 - 1), (t & (2**64 - 1)) >> 32))  # noqa: E731, B023
        assert all(test(r["token"]) for r in tokens.collect())
        others = [r["t"] for r in spark.range(10_000, 12_000).select(F.xxhash64("id").alias("t")).collect()]
        assert sum(map(test, others)) <= share * len(others)


def test_decontamination_takes_ids_of_any_type(spark):
    item = " ".join("item%d" % k for k in range(13))
    bench = spark.createDataFrame([("b", item)], "item_id string, text string")
    docs = spark.createDataFrame([("x", item), ("y", "nothing"), (None, item), ("x", None)], "doc_id string, text string")
    got = sorted((str(r["doc_id"]), r["n_hit"], r["contaminated"]) for r in decontamination.decontaminate(docs, bench).collect())
    assert got == [("None", 13, True), ("x", 0, False), ("x", 13, True), ("y", 0, False)]
    assert decontamination.decontaminate(docs.filter("doc_id = 'y'"), bench).first()["n_hit"] == 0


def test_decontamination_of_nothing(spark):
    docs, none = spark.createDataFrame(corpus()[:5], SCHEMA), spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.decontaminate(docs, none).agg(F.sum("n_hit")).first()[0] == 0
    assert decontamination.decontaminate(docs.limit(0), none).count() == 0
    other = spark.createDataFrame([(1, "nowhere to be found")], "item_id bigint, text string")
    assert decontamination.decontaminate(docs, other).filter("contaminated").count() == 0


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, distance=4):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    best = {}
    for k, i in enumerate(ids):
        best[find(k)] = min(best.get(find(k), i), i)
    return {i: best[find(k)] for k, i in enumerate(ids)}


def test_simhash_matches_brute_force(spark):
    rng = random.Random(2)
    rows = corpus(11, 80)
    for k in range(40):  # near copies
        words = " ".join("n%d" % (j * 7 % 90) for j in range(80)).split()
        words[rng.randrange(80)] = "other%d" % rng.randrange(3)
        rows.append((500 + k, " ".join(words), "en", "a", 1))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    fps = [brute_fingerprint(r[1]) for r in rows]
    assert all(int(got[r[0]]["fingerprint"], 16) == f for r, f in zip(rows, fps))
    want = brute_components([r[0] for r in rows], fps)
    assert {i: r["component_id"] for i, r in got.items()} == want
    kept = simhash.keep_one(frame(spark, rows))
    assert {r["doc_id"] for r in kept.collect()} == set(want.values()) and "kept" in kept.columns
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(4, "a b c", "en", "a", 1)] * 2 + [(None, "x y z q", "en", "a", 1)], SCHEMA)
    assert simhash.near_duplicates(twice).count() == 3 and simhash.keep_one(twice).count() == 2


def test_one_row_is_kept_of_each_class_whatever_its_id(spark):
    rng = random.Random(8)
    texts = [" ".join("k%d" % rng.randrange(10**6) for _ in range(60)) for _ in range(8)]
    ids = [None, None, None, 5, 5, None, 9, None]
    rows = [(i, t, "en", "a", 1) for i, t in zip(ids, texts)]
    rows += [(None, texts[3], "en", "a", 1), (2, texts[5], "en", "a", 1), (None, texts[0], "en", "a", 1), (9, texts[6], "en", "a", 1)]
    fps = [brute_fingerprint(r[1]) for r in rows]
    assert len(set(fps)) == len(texts) and set(brute_components(list(range(12)), fps).values()) == set(range(8))
    got = simhash.keep_one(frame(spark, rows))
    want = [(i, t) for i, t in zip([None, None, None, 5, 5, 2, 9, None], texts)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert got.columns == frame(spark, rows).columns


def test_a_contaminated_text_removes_only_its_own_row(spark, tmp_path):
    import corpus_pipeline

    item = " ".join("item%d" % k for k in range(20))
    spark.createDataFrame([("b", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, item, "en", "a", 1), (None, "clean one", "en", "a", 1), (3, item, "en", "a", 1), (3, "clean two", "en", "a", 1), (4, None, "en", "a", 1)]
    got = corpus_pipeline.drop_contaminated(spark, frame(spark, rows), str(tmp_path))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(None, "clean one"), (3, "clean two"), (4, None)], key=str)


@pytest.mark.parametrize("size", [10, 3_000, 10**6, 10**9])
def test_block_masks_miss_no_pair(size):
    rng = random.Random(size)
    masks = simhash.block_masks(4, size)
    for _ in range(2000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randrange(5)):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_dense_groups_of_fingerprints(spark):
    """One bucket far over the small-group size: a cluster, a chain and strays."""
    rng = random.Random(4)
    base = 0x5555AAAA00FF1234
    fps = {base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)} | {base ^ ((1 << k) - 1) << 30 for k in range(0, 30)} | {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    found = {r["node"] & (2**64 - 1): r["component"] for r in components.connected_components(simhash.near_links(df)).collect()}
    want = brute_components(list(range(len(fps))), fps)
    groups = {}
    for k, f in enumerate(fps):
        groups.setdefault(want[k], set()).add(found.get(f, f"alone{k}"))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_large_groups_are_blocked_again_without_losing_a_link():
    rng = random.Random(6)
    high = 0x1234567 << 36
    fps = {high | rng.getrandbits(36) for _ in range(3000)}
    near = {f ^ (1 << a) ^ (1 << b) for f in list(fps)[:300] for a, b in [(rng.randrange(36), rng.randrange(36))]}
    fps = np.array(sorted(fps | near), np.uint64)
    parent = {int(f): int(f) for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in np.concatenate(simhash._within(fps, 4, large=100)).tolist():
        parent[find(a)] = find(b)
    ids = list(range(len(fps)))
    want = brute_components_fast(fps)
    groups = {}
    for i in ids:
        groups.setdefault(want[i], set()).add(find(int(fps[i])))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def brute_components_fast(fps, distance=4):
    """Components by all pairs, a row of them at a time."""
    label = np.arange(len(fps))
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= distance)
        least = label[near].min()
        for old in set(label[near].tolist()) - {least}:
            label[label == old] = least
    return label.tolist()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[500] == got[501] == 500


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding_is_jump_hashing_with_gapless_slots(spark):
    import zlib

    rows = corpus(1, 150) + [(-5, "x", "en", "a", 1), (2**62, "y", "en", "a", 1), (None, None, None, None, None), (7, "other", "en", "a", 1)]
    got = sharding.assign_shards(frame(spark, rows), 40).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        assert r["shard"] == jump(r["doc_id"] or 0, 40) and r["grown_shard"] == jump(r["doc_id"] or 0, 41)
        assert r["grown_shard"] in (r["shard"], 40) and r["law"] == "key"
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((str(i), len((t or "").encode()) + 16, str(zlib.crc32(t.encode()) if t is not None else None)) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["size"], str(r["text_crc32"])) for r in got) == want
    sql = in_duckdb(oracles.sharding(), rows)
    plain = lambda d: sorted(str(tuple(row)) for row in d)
    wanted = sql[got[0].__fields__].astype(object)
    assert plain(wanted.where(wanted.notna(), None).values.tolist()) == plain(tuple(r) for r in got)
    few = sharding.assign_shards(frame(spark, rows), 100, part_rows=1).collect()
    assert all(r["shard"] == jump(r["doc_id"] or 0, 100) and r["grown_shard"] == jump(r["doc_id"] or 0, 101) for r in few)
    keys = spark.range(500).select(F.col("id").cast("decimal(38,0)").alias("k"))
    short = sharding.with_jump_shards(keys, "k", 60, "both", first_steps=2).collect()
    assert all((r["both"]["shard"], r["both"]["grown"]) == (jump(int(r["k"]), 60), jump(int(r["k"]), 61)) for r in short)
    assert sharding.assign_shards(spark.createDataFrame([], SCHEMA)).count() == 0
    texts = spark.createDataFrame([("a",), ("b",), (None,)], "doc_id string").withColumn("text", F.lit("t"))
    assert sharding.assign_shards(texts, 3).count() == 3


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = corpus(1, 30)
    sharding.write_shards(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(rows) and all(r["shard"] == jump(r["doc_id"], 4) for r in back.collect())


def test_sha_of_an_empty_document(spark):
    d = substring_dedup.remove_repeats(spark.createDataFrame([(1, None, "en", "a", 1)], SCHEMA))
    assert d.select(F.sha2("kept_text", 256)).first()[0] == hashlib.sha256(b"").hexdigest()


CLASHES = ("kept_text", "n_words", "n_removed", "lang_pred", "lang_score", "score", "class", "rank", "digest", "fp", "kept_id", "bad_id", "bad_digest", "at", "token", "size", "key")


@pytest.mark.parametrize("ids", ["bigint", "string"])
def test_pipeline_stages_take_any_ids_columns_and_gaps(spark, tmp_path, ids):
    import corpus_pipeline

    words = " ".join("word%d" % k for k in range(40))
    rows = [(1, words), (1, "the other text of one id"), (None, words), (None, "a text of no id"), (None, None), (2, ""), (3, words + " more"), (3, words + " more"), (4, None)]
    spark.createDataFrame([("b", " ".join("bench%d" % k for k in range(13)))], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("doc_id", F.col("doc_id").cast(ids))
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("bigint"), **{c: F.lit(7) for c in CLASHES}})
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        found = got.count()
        if name != "sentencepiece":
            assert got.columns == docs.columns and got.filter("rank <> 7 OR n_words <> 7").count() == 0
        assert found == {"language_id": 6, "simhash_near_dedup": 5, "substring_dedup": 9, "benchmark_decontamination": 9}.get(name, found) and (name != "sentencepiece" or found > 9)
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0 and none.columns == got.columns
