"""The similarity join of quotes and lines against a comparison of all pairs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators import quotes as Q
from parley.plans import catalog
from parley.sources import model


def _random_texts(seed, n):
    """Short texts over few letters, one of them outside the basic plane, and altered copies of one another."""
    rng = random.Random(seed)
    out = ["", None, "a", "ab", "  A ", "aaaaaaaaaaaa", "aaaaaaaaaaab", "b" * 250, "b" * 230 + "ab" * 9]
    while len(out) < n:
        if rng.random() < 0.5:
            t = "".join(rng.choice("abc d😀") for _ in range(rng.randint(2, 40)))
        else:
            t = list(rng.choice(out[5:]))
            for _ in range(rng.randint(1, 4)):
                at = rng.randint(0, len(t))
                t[at : at + rng.randint(0, 2)] = rng.choice(["", "a", "xyz", " "])
            t = "".join(t)
        out.append(t)
    return out


@pytest.mark.parametrize("fuzzy", [0.85, 0.95])
def test_no_pair_is_lost(spark, fuzzy):
    texts = _random_texts(11, 260)
    of = lambda i, t: i % 2 if len(t or "") > 8 else 2  # noqa: E731  short texts, which many contain, have their own meeting
    asked = spark.createDataFrame([(of(i, t), i, t) for i, t in enumerate(texts[:130])] + [(None, 900, "a"), (7, 901, "a")], "meeting_id bigint, item bigint, quote string")
    lines = spark.createDataFrame([(of(i, t), i, t) for i, t in enumerate(texts[:9] + texts[100:])], "meeting_id bigint, position int, text string")
    got = {r["item"]: (r["verified"], r["source_position"]) for r in Q.quote_matches(asked, lines, fuzzy).collect()}
    hay = [tuple(r) for r in lines.select("meeting_id", "position", X.normalise(F.col("text")), X.tokens(F.col("text"))).collect()]
    ways = set()
    for m, item, needle, words in asked.select("meeting_id", "item", X.normalise(F.col("quote")), X.tokens(F.col("quote"))).collect():
        heard = [h for h in hay if h[0] == m and m is not None and h[2] and needle]
        inside = [p for _, p, h, _ in heard if needle in h or h in needle]
        alike = max(((difflib.SequenceMatcher(None, needle, h).ratio(), -p) for _, p, h, _ in heard), default=(0.0, 0))
        words = set(words)
        shared = any(len(words) >= 2 and len(words & set(w)) / len(words) >= 0.65 for *_, w in heard)
        near = alike[0] >= fuzzy
        want = (True, min(inside)) if inside else (near or shared, -alike[1] if near else None)
        assert got[item] == want, (item, needle)
        ways.add("contained" if inside else "alike" if near else "shared" if shared else "no")
    assert len(got) == 132 and {"contained", "alike", "no"} <= ways


def test_most_open_pairs_never_reach_python(spark, sf):
    lines = model.lines(spark, sf)
    q, said = Q._classes(Q._read(catalog._quotes(lines), "item", "quote")), Q._classes(Q._read(lines, "position", "text"))
    left = q.join(Q._contained(q, said), ["meeting_id", "id"], "left_anti")  # containment settles the others
    pairs = left.join(said.select("meeting_id"), "meeting_id").count()
    assert 0 < Q.alike_candidates(left, said, 0.85).count() < 0.2 * pairs


def test_bounds_that_would_lose_pairs_are_refused(spark):
    none = spark.createDataFrame([], "meeting_id bigint, item bigint, quote string"), spark.createDataFrame([], "meeting_id bigint, position int, text string")
    assert Q.quote_matches(*none).count() == 0
    for wrong in ({"fuzzy": 0.8}, {"overlap": 0.0}):
        with pytest.raises(ValueError):
            Q.quote_matches(*none, **wrong)


@pytest.mark.parametrize("small", [0, 60, 10_000])
def test_small_and_large_meetings_find_the_same(spark, monkeypatch, small):
    texts = _random_texts(5, 150)
    asked = spark.createDataFrame([(i % 2, i, t) for i, t in enumerate(texts[:100])] + [(None, 900, "a"), (7, 901, "a")], "meeting_id bigint, item bigint, quote string")
    lines = spark.createDataFrame([(int(i % 3 == 0), i, t) for i, t in enumerate(texts)], "meeting_id bigint, position int, text string")  # 100 lines and 50
    found = lambda: [sorted(map(str, f(asked, lines).drop("quote").collect())) for f in (Q.contained_quotes, Q.shared_quotes, Q.quote_matches)]
    want = found()
    monkeypatch.setattr(Q, "SMALL", small)
    assert found() == want and len(want[0]) == 102


def test_no_join_of_quotes_broadcasts_texts_or_terms(spark, sf):
    lines = model.lines(spark, sf)
    for of in (Q.contained_quotes, Q.shared_quotes):
        plan = of(catalog._quotes(lines), lines)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        joins = [x for x in plan if " Join " in x or x.startswith("Join ")]
        terms = [x for x in joins if "gram#" in x or "word#" in x or "hay#" in x or "heard#" in x]
        assert terms and all("strategy=merge" in x for x in terms)


def _long_texts(seed, n):
    """Texts around the 200 letters from which the sequence ratio looks up no common letter, and altered copies of them."""
    rng = random.Random(seed)
    texts = []
    while len(texts) < n:
        if rng.random() < 0.4 or not texts:
            t = "".join(rng.choice("thenoiard "[: rng.randint(2, 10)]) if rng.random() < 0.97 else rng.choice("kzqvé😀") for _ in range(rng.randint(150, 420)))
        else:
            t = list(rng.choice(texts))
            for _ in range(rng.randint(1, 30)):
                at = rng.randint(0, len(t))
                t[at : at + rng.randint(0, 3)] = rng.choice(["", "x", "the", "k "])
            t = "".join(t)
        texts.append(t)
    return texts


def test_the_bound_holds_for_every_pair_and_settles_most():
    texts, near, left = _long_texts(3, 60), 0, 0
    for a in texts:
        for b in texts:
            ratio, most = difflib.SequenceMatcher(None, a, b).ratio(), Q.most_matched(a, b)
            assert 2 * most >= ratio * (len(a) + len(b)) - 1e-9
            assert Q.sequence_ratio(a, b, 0.85) == (ratio if ratio >= 0.85 else 0.0)
            near, left = near + (ratio >= 0.85), left + (2 * most >= 0.85 * (len(a) + len(b)))
    assert 60 < near <= left < 1.2 * near


@pytest.mark.parametrize("small", [0, 10_000])
def test_long_texts_match_as_by_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(Q, "SMALL", small)
    texts = _long_texts(7, 90)
    asked = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts[:60])], "meeting_id bigint, item bigint, quote string")
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts[30:])], "meeting_id bigint, position int, text string")
    hay = {r["position"]: r["hay"] for r in lines.select("position", X.normalise(F.col("text")).alias("hay")).collect()}
    ways = set()
    for r in Q.quote_matches(asked.withColumn("needle", X.normalise(F.col("quote"))), lines).collect():
        inside = [p for p, h in hay.items() if h in r["needle"] or r["needle"] in h]
        ratio, at = max((difflib.SequenceMatcher(None, r["needle"], h).ratio(), -p) for p, h in hay.items())
        assert r["source_position"] == (min(inside) if inside else -at if ratio >= 0.85 else None)
        assert r["verified"] or r["source_position"] is None
        ways.add("contained" if inside else "alike" if ratio >= 0.85 else "no")
    assert ways == {"contained", "alike", "no"}


def test_small_meetings_read_quotes_and_lines_once(spark):
    asked = spark.createDataFrame([(1, 1, "we ship it on friday"), (None, 2, "we ship")], "meeting_id bigint, item bigint, quote string")
    lines = spark.createDataFrame([(1, 0, "we shipp it on fridays")], "meeting_id bigint, position int, text string")
    got = Q.quote_matches(asked, lines)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2 and "levenshtein" not in plan
    assert sorted((r["item"], r["verified"], r["source_position"]) for r in got.collect()) == [(1, True, 0), (2, False, None)]


def test_long_lines_of_few_rare_letters_meet_by_runs(spark):
    texts = _long_texts(9, 90)
    asked = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts[:60])], "meeting_id bigint, item bigint, quote string")
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts[30:])], "meeting_id bigint, position int, text string")
    q, said = Q._classes(Q._read(asked, "item", "quote")), Q._classes(Q._read(lines, "position", "text"))
    found = Q._runs(said, 0.85).filter("run IS NOT NULL")
    got = {(r["id"], r["position"]) for r in Q._by_runs(q, found, 0.85).collect()}
    a, b = q.collect(), found.collect()
    near = {(x["id"], y["id"]) for x in a for y in b if difflib.SequenceMatcher(None, x["norm"], y["norm"]).ratio() >= 0.85}
    assert len(b) > 40 and 20 < len(near) and near <= got and len(got) < 0.1 * len(a) * len(b)
