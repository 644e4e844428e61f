"""Classifiers by held-out accuracy, sampling against exact enumeration, chat formatting by round trip, the pipeline by invariants."""

import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.llm import chat_format, gam, language_id, piece_sampling, quality_classifier, queries, toxicity
from parley.llm.piece_lattice import Pieces, Solved

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "123 -- !!"), (4, "\n\n"), (5, "word " * 60_000), (6, "x" * 300_000), (7, "e"), (7, "e"), (None, "the end of the thing")]


def odd(spark):
    d = spark.createDataFrame(ODD, "doc_id bigint, text string")
    return d.withColumns({c: F.lit("x") for c in ("lang", "score", "SCORE2", "predicted", "held_out")})


# ---------------------------------------------------------------- language


def test_language_held_out_accuracy(spark):
    found = queries.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out AND lang_pred <> 'und'").toPandas()
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() > 0.97
    assert found.filter("score < 0 OR score > 1").count() == 0 and found.count() == 1000


def test_language_of_odd_texts(spark):
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"), language_id.Settings(per_language=60, landmarks=32))
    got = language_id.classify(odd(spark), model)
    assert got.columns.count("score") == 1 and got.count() == len(ODD)
    by = {r["doc_id"]: r for r in got.collect()}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3, 4)) and all(by[i]["lang_pred"] != "und" for i in (5, 6, 7))
    none = language_id.fit(spark.createDataFrame([(None, None), ("a", None), (None, "en"), ("123", "en")], "text string, lang string"))
    assert none is None and language_id.classify(odd(spark), None).filter("lang_pred <> 'und'").count() == 0
    assert language_id.classify(odd(spark).limit(0), model).count() == 0


def test_learning_rows_leave_the_fold_out(spark):
    import zlib

    ids = [(i, "t", "en") for i in range(200)]
    kept = language_id.learning_rows(spark.createDataFrame(ids, "doc_id bigint, text string, lang string")).count()
    assert kept == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(200))


def test_language_model_solves_its_ridge_system_as_directly():
    """Kernel, landmark map and ridge against dense linear algebra on n-gram sets."""
    rng = np.random.default_rng(5)
    maps = language_id.Bitmaps(1 << 14, 3)
    texts = ["".join(rng.choice(list(a), 40)) for a in ("abcd ", "cdef ", "efgh ") for _ in range(12)]
    bits = np.zeros((len(texts), 1 << 14), bool)
    for t, b in zip(texts, bits):
        maps.fill(t, b)
    y = np.repeat([0, 1, 2], 12)
    s = language_id.Settings(landmarks=18)
    m = language_id.solve(np.packbits(bits, axis=1), y, ["a", "b", "c"], s)
    sets = [set(np.flatnonzero(b).tolist()) for b in bits]
    marks = [i for k in range(3) for i in np.flatnonzero(y == k)[:6].tolist()]
    kernel = np.array([[len(p & sets[q]) / np.sqrt(len(p) * len(sets[q])) for q in marks] for p in sets])
    assert np.allclose(m.kernel(bits.astype(np.float32)), kernel, atol=1e-5)
    values, vectors = np.linalg.eigh(kernel[marks])
    z = kernel @ (vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()]))
    z = np.column_stack([z / np.linalg.norm(z, axis=1, keepdims=True), np.ones(len(z))])
    want = np.linalg.lstsq(np.vstack([z, np.sqrt(s.ridge * len(z) / z.shape[1]) * np.eye(z.shape[1])]), np.vstack([np.where(y[:, None] == np.arange(3), 1.0, -1.0), np.zeros((z.shape[1], 3))]), rcond=None)[0]
    assert np.allclose(m.features(bits.astype(np.float32)) @ m.coef, z @ want, atol=1e-2)
    grams = {"ab"[i : i + n] for n in (1, 2) for i in range(3 - n)}
    one = np.zeros(1 << 14, bool)
    maps.fill("ab", one)
    assert one.sum() == len(grams)


def test_every_language_is_learnt_however_many_and_however_copied(spark):
    rows = [(f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 9 + str(j), f"l{k:03d}") for k in range(230) for j in range(2)]
    rows += [("same text over and over", "copied")] * 3000 + [(f"copied words number {chr(97 + j)}{chr(99 + j)}", "copied") for j in range(20)]
    m = language_id.fit(spark.createDataFrame(rows, "text string, lang string"), language_id.Settings(per_language=20, landmarks=256))
    assert len(m.languages) == 231 and "copied" in m.languages


# ---------------------------------------------------------------- quality


def test_quality_held_out_accuracy(spark):
    got = queries.op2_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert ((got.quality == 1) == (got.predicted == 1)).mean() > 0.9


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no feature tells anything alone
    m = gam.fit_additive(x, y)
    assert (0, 1) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.9
    total = m.intercept + sum(m.tables[j, m.bins(x)[7, j]] for j in range(3)) + sum(t[m.bins(x)[7, i], m.bins(x)[7, j]] for (i, j), t in zip(m.pairs, m.pair_tables))
    assert abs(total - m.logit(x)[7]) < 1e-9


@pytest.mark.parametrize("labels", [[], [(7, 1, 1)], [(None, 1, 1), (5, None, None)], [(1, 0, 0), (2, 1, 1), (2, 0, 0)]])
def test_classifiers_with_hardly_any_labels(spark, labels):
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    for found in (quality_classifier.classify_quality(odd(spark), frame), toxicity.classify_toxicity(odd(spark), frame)):
        rows = found.collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


# ---------------------------------------------------------------- toxicity


def test_toxicity_held_out_accuracy(spark):
    got = queries.op3_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").toPandas()
    hit = (got.toxic == 1) & (got.predicted == 1)
    assert hit.sum() / (got.predicted == 1).sum() > 0.95 and hit.sum() / (got.toxic == 1).sum() >= 0.9


def small_corpus():
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(400)]
    texts, labels = [], []
    for k in range(400):
        words = rng.choice(plain, 30).tolist()
        if k % 5 == 0:
            words.insert(k % 30, ("grumblefoot", "wretchling")[k % 2])
        texts.append(" ".join(words))
        labels.append(k % 5 == 0)
    return plain, texts, labels


def test_toxicity_of_unseen_misspellings():
    plain, texts, labels = small_corpus()
    s = toxicity.Settings(buckets=1 << 14, batch=16)
    m = toxicity.train(toxicity.assemble(list(toxicity.read_texts(texts, s)), s, block=500), labels, s)
    bags = toxicity.Bags(s)
    score = lambda t: float(m.score(m.log_odds(bags, t)))
    clean = " ".join(plain[:40])
    assert score(clean) < 0.3 and score(clean + " GRUMBLEFOOT!") > 0.7
    assert score("grumblefooot " + clean) > 5 * score(clean)
    assert all(score("grumblefooot") > score(w) for w in plain)  # a spelling never seen stands above every plain word
    assert score(" ".join(plain) * 20 + " grumblefoot") > 5 * score(" ".join(plain) * 20)  # one in 8,000 words
    assert 0 <= score("") <= 1 and score("") == score(None) == score("12 !")


def brute_log_odds(m, bags, text):
    """The softmax over the weighted mean of word embeddings, word by word."""
    codes = bags.codes(text)
    odds = []
    for a, n in zip(*bags.words(codes)):
        (bucket, _) = bags.lists(codes, np.array([a]), np.array([n]))
        odds.append(m.values[bucket].mean() + m.bias)
    w = np.exp(odds)
    return float(w @ np.array(odds) / w.sum())


def test_a_text_scores_as_the_average_of_its_words_whole_or_in_pieces():
    m = toxicity.ToxicityModel(np.random.default_rng(0).normal(size=1 << 12).astype(np.float32), -1.0, -2.0, toxicity.Settings(buckets=1 << 12))
    text = "Ab, c défghij! xyz-xyz a " * 40 + "x" * 500
    want = brute_log_odds(m, toxicity.Bags(m.settings), text)
    for piece in (1 << 18, 50, 7):
        assert abs(m.log_odds(toxicity.Bags(m.settings, piece), text) - want) < 1e-6


def test_training_does_not_hang_on_who_read_which_text():
    _, texts, labels = small_corpus()
    texts = [*texts[:60], None, "", texts[0]]
    s = toxicity.Settings(buckets=1 << 12, epochs=2)
    alone = toxicity.assemble([r for t in texts for r in toxicity.read_texts([t], s)], s)
    together = toxicity.assemble(list(toxicity.read_texts(texts, s)), s, block=500)
    for field in ("word", "times", "size", "bucket", "grams"):
        assert np.array_equal(getattr(alone, field), getattr(together, field))
    assert together.size[60] == together.size[61] == 0 and np.array_equal(together.word[: together.size[0]], together.word[-together.size[-1] :])
    assert np.isfinite(toxicity.train(together, [*labels[:60], 1, 0, 1], s).values).all()


def test_gradient_of_the_text_loss():
    """One step from the start moves the parameters along the loss's numerical gradient."""
    rng = np.random.default_rng(2)
    odds, times, y = rng.normal(size=5), np.array([1.0, 2, 1, 3, 1]), 1.0

    def loss(o):
        a = times * np.exp(o)
        z = (a * o).sum() / a.sum()
        return -np.log(1 / (1 + np.exp(-z))) if y else 0

    a = times * np.exp(odds) / (times * np.exp(odds)).sum()
    z = a @ odds
    exact = a * (1 + odds - z) * (1 / (1 + np.exp(-z)) - y)
    step = 1e-6
    assert np.allclose(exact, [(loss(odds + step * e) - loss(odds - step * e)) / (2 * step) for e in np.eye(5)], atol=1e-6)


def test_bag_means_agree_with_lists():
    bags = toxicity.Bags(toxicity.Settings(buckets=1 << 12))
    values = np.random.default_rng(0).random(1 << 12)
    codes = bags.codes("Ab, c défghij! xyz-xyz a")
    idx, count = bags.lists(codes, *bags.words(codes))
    first = np.cumsum(count) - count
    want = [values[idx[a : a + n]].mean() if n else 0 for a, n in zip(first, count)]
    assert np.allclose(bags.means(codes, values), want)
    keys = bags.keys(codes, *bags.words(codes))
    assert len(set(keys.tolist())) == 5 and keys[3] == keys[4]


# ---------------------------------------------------------------- SentencePiece


def tiny():
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "aba", *[f"<0x{i:02X}>" for i in range(256)]]
    scores = [0.0, -1.0, -2.0, -3.0, -4.0, -5.0, -6.0, -7.0, *[0.0] * 256]
    return Pieces(pieces, scores, [p.startswith("<0x") for p in pieces], [p == "<unk>" for p in pieces])


def every_segmentation(vocab, text):
    """ids -> probability, by listing."""
    names = {p: i for i, p in enumerate(["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "aba"]) if i}
    t = "▁" + text.replace(" ", "▁")

    def walk(at):
        if at == len(t):
            yield ()
        for p, i in names.items():
            if t.startswith(p, at):
                for rest in walk(at + len(p)):
                    yield (i, *rest)

    found = {s: math.exp(sum(vocab.log_p[i] for i in s)) for s in walk(0)}
    z = sum(found.values())
    return {s: p / z for s, p in found.items()}


def test_samples_follow_the_lattice_without_replacement():
    vocab = tiny()
    text = "abab ba"
    exact = every_segmentation(vocab, text)
    n = 6000
    runs = piece_sampling.sample_texts(vocab, [text] * n, list(range(n)), 3)
    first = Counter(tuple(r[0][0].tolist()) for r in runs)
    for s, p in exact.items():
        assert abs(first[s] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-3
    pairs = Counter((tuple(r[0][0].tolist()), tuple(r[1][0].tolist())) for r in runs)
    for (s, t), p in {(s, t): ps * pt / (1 - ps) for (s, ps), (t, pt) in itertools.permutations(exact.items(), 2)}.items():
        assert abs(pairs[s, t] / n - p) < 4.5 * math.sqrt(p * (1 - p) / n) + 1e-3
    for r in runs[:300]:
        assert len({tuple(x[0].tolist()) for x in r}) == 3
        assert all(abs(x[1] - math.log(exact[tuple(x[0].tolist())])) < 1e-9 and x[2] <= 1e-9 for x in r)
    # sum of 1/inclusion over the samples estimates the number of segmentations without bias
    estimate = np.mean([sum(math.exp(-x[2]) for x in r) for r in runs])
    assert abs(estimate - len(exact)) < 0.15 * len(exact)


def test_all_segmentations_when_k_is_large():
    vocab = tiny()
    (found,) = piece_sampling.sample_texts(vocab, ["abab"], [5], 50)
    assert {tuple(x[0].tolist()) for x in found} == set(every_segmentation(vocab, "abab")) and all(x[2] == 0 for x in found)


def test_samples_hang_on_the_key_not_the_batch():
    vocab = Pieces.load(queries.MODEL)
    texts = ["The quick brown fox", "", "jumps over", "The quick brown fox"]
    together = piece_sampling.sample_texts(vocab, texts, [1, 2, 3, 1], 2)
    alone = piece_sampling.sample_texts(vocab, texts[2:3], [3], 2)
    plain = lambda r: [(x[0].tolist(), x[1]) for x in r]
    assert plain(together[2]) == plain(alone[0]) and plain(together[0]) == plain(together[3])


@pytest.fixture(scope="module")
def vocab():
    return Pieces.load(queries.MODEL)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",)), max_size=40), min_size=1, max_size=4))
def test_every_sample_decodes_to_its_text(vocab, texts):
    for text, found in zip(texts, piece_sampling.sample_texts(vocab, texts, list(range(len(texts))), 2)):
        assert found and all(vocab.decode(ids.tolist()) == text for ids, _, _ in found)


def test_the_library_decodes_the_same(vocab):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)
    for text in ("Hello  world\n foo\tbar", "naïve 梦 😀 x"):
        for ids, _, _ in piece_sampling.sample_texts(vocab, [text], [4], 3)[0]:
            assert model.decode(ids.tolist()) == text


def test_segmentations_of_a_table(spark):
    got = piece_sampling.sample_segmentations(odd(spark), queries.MODEL, k=2)
    rows = got.collect()
    assert all(r["decoded"] and r["n_pieces"] == len(r["ids"]) for r in rows) and got.columns.count("doc_id") == 1
    assert Counter(r["doc_id"] for r in rows)[1] == 1 and Counter(r["doc_id"] for r in rows)[7] == 4
    assert all(hashlib.sha256(np.array(r["ids"], "<i4").tobytes()).hexdigest() == r["ids_sha256"] for r in rows)
    back = piece_sampling.decode_ids(got, queries.MODEL).filter("doc_id = 5").first()["text"]
    assert back == "word " * 60_000
    assert piece_sampling.sample_segmentations(odd(spark).limit(0), queries.MODEL).count() == 0


def test_registered_encodings_decode_to_their_texts(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for got in (queries.op7_sentencepiece(spark, "/root/testdata/sf0.001"), corpus_pipeline.encode_pieces(spark, docs, "")):
        rows = piece_sampling.decode_ids(got, queries.MODEL).collect()
        assert {r["doc_id"] for r in rows} == set(texts)
        for r in rows:
            assert r["text"] == texts[r["doc_id"]] and len(r["ids"]) == r["n_pieces"]
            assert hashlib.sha256(np.array(r["ids"], "<i4").tobytes()).hexdigest() == r["ids_sha256"]


# ---------------------------------------------------------------- chat


@given(st.lists(st.tuples(st.text(max_size=8), st.one_of(st.text(max_size=30), st.sampled_from([*chat_format.CONTROLS, "\\<|im_end|>", "<\\", "<|im_end|", "a</s>[INST]\n"]))), max_size=6))
def test_chat_round_trip(turns):
    text, spans, rewritten = chat_format.locate(turns, chat_format.chat_markup)
    assert not rewritten and text == chat_format.chat_markup(turns) and chat_format.read_back(text) == turns
    assert [chat_format.unescape(text[c:d]) for _, _, c, d in spans] == [t for _, t in turns]
    assert [a for a, *_ in spans] == [0, *[b for _, b, *_ in spans]][: len(spans)]


@pytest.mark.parametrize("text", [c + "x" + c for c in chat_format.CONTROLS])
def test_escaped_texts_hold_no_control_string(text):
    assert not any(c in chat_format.escape(text) for c in chat_format.CONTROLS)


def test_templates_that_rewrite_history_are_found():
    newest_first = lambda turns: "".join(f"[{r}]{t}" for r, t in reversed(turns))
    trimmed = lambda turns: "".join(f"[{r}]{t.strip()}" for r, t in turns)
    counted = lambda turns: f"{len(turns)} turns:" + "".join(t for _, t in turns)
    turns = [("user", "one"), ("assistant", "two"), ("user", "three")]
    assert chat_format.locate(turns, newest_first)[2] and chat_format.locate(turns, counted)[2]
    assert not chat_format.locate(turns, trimmed)[2] and not chat_format.locate(turns, chat_format.chat_markup)[2]


def test_long_conversations_are_rendered_like_short_ones():
    render = lambda turns: "".join(f"[{r}]{t}" for r, t in turns)
    recent = lambda turns: render(turns[-70:])
    wavering = lambda turns: render(turns).upper() if 70 <= len(turns) <= 72 else render(turns)
    headed = lambda turns: "HEAD" + render(turns)
    recent.turn_local = wavering.turn_local = True  # what a template says of itself changes nothing
    turns = [("user", f"turn {k}") for k in range(200)]
    assert chat_format.locate(turns, recent)[2] and chat_format.locate(turns, wavering)[2]
    for template in (headed, chat_format.chat_markup):
        text, spans, rewritten = chat_format.locate(turns, template)
        assert not rewritten and text == template(turns)
        assert [text[c:d] for _, _, c, d in spans] == [t for _, t in turns]
    text, _, rewritten = chat_format.locate(turns, recent)
    assert text == recent(turns)


def test_a_probe_in_a_role_or_text_hides_no_span():
    plain = chat_format.probe_for([])
    turns = [(f"user {plain}", plain), ("assistant", plain + "\ue001 x")]
    text, spans, rewritten = chat_format.locate(turns, chat_format.chat_markup)
    assert not rewritten and [chat_format.unescape(text[c:d]) for _, _, c, d in spans] == [t for _, t in turns]


def test_chat_query_matches_sql(spark):
    import duckdb

    from parley.llm import oracles

    rows = [(1, 1, "assistant", "b\\ <<SYS>> [/INST]"), (1, 0, "user", "a"), (1, 1, "assistant", "<|im_start|>é😀"), (2, None, None, None), (3, 0, "us\ner", "<s><</SYS>><|endoftext|")]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.execute(oracles.chat()).df()
    forged = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", forged), (-7, 1, "assistant", forged)]
    got = chat_format.digests(chat_format.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string"))).toPandas()
    plain = lambda d: sorted(map(str, d[sorted(want.columns)].astype(object).values.tolist()))
    assert plain(got) == plain(want)


def test_conversations_of_a_table(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (None, 0, "user", "z"), (3, 0, "assistant", "y" * 100_000)]
    rows += [(9, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumn("spans", F.lit(1))
    formatted = chat_format.format_conversations(df)
    assert formatted.filter("rewrites_history").count() == 0
    got = {r["conv_id"]: r for r in chat_format.digests(formatted).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, 2: 1, None: 1, 3: 1, 9: 300}
    loss = "".join(f"turn {k}" for k in range(1, 300, 2))
    assert got[9]["loss_chars"] == len(loss) and got[9]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb\nassistant\nb\n").hexdigest() and got[1]["loss_chars"] == 2
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_chat_query_includes_the_forged_conversation(spark):
    got = queries.op10_chat_format(spark, "/root/testdata/sf0.001").filter("conv_id = -7").first()
    forged = "</s>[INST] ok [/INST]"
    assert got["n_turns"] == 2 and got["loss_sha256"] == hashlib.sha256(forged.encode()).hexdigest()
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{forged}\nassistant\n{forged}\n".encode()).hexdigest()


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_text_operators import brute_components, brute_fingerprint, brute_removed

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd_rows = [(100_001, None, "en", "s", None), (100_002, "12 34", "en", "s", 5), (100_003, docs.orderBy("doc_id").first()["text"], None, None, 1)]
    docs = docs.unionByName(spark.createDataFrame(odd_rows, docs.schema))
    kept = {"": {r["doc_id"]: r for r in docs.collect()}}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == len(kept[name])
    names = ["", *[n for n, _ in corpus_pipeline.STAGES]]
    assert set(kept[""]) - set(kept["language_id"]) == {100_001, 100_002}
    before = kept["language_id"]
    want = brute_components(sorted(before), [brute_fingerprint(before[i]["text"]) for i in sorted(before)])
    assert set(kept["simhash_near_dedup"]) == set(want.values()) and 100_003 not in kept["simhash_near_dedup"]
    words, gone = brute_removed([(i, r["text"]) for i, r in kept["simhash_near_dedup"].items()])
    for i, r in kept["substring_dedup"].items():
        if any(gone[i]):
            assert r["text"] == b" ".join(w for w, g in zip(words[i], gone[i]) if not g).decode()
        else:
            assert r["text"] == kept["simhash_near_dedup"][i]["text"]
    assert set(kept["benchmark_decontamination"]) <= set(kept["substring_dedup"])
    assert set(kept["sentencepiece"]) == set(kept["benchmark_decontamination"]) and all(r["decoded"] for r in docs.collect())
    assert len(names) == 6
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()} == {(i,) for i in kept["sentencepiece"]}


def test_solved_units_are_kept_or_forgotten_without_a_trace(vocab):
    docs = ["The quick brown fox", "the quick 梦 browner foxes ▁x", "", "aaaa" * 40, "The quick brown fox jumps"] * 3
    keys = list(range(len(docs)))
    whole = piece_sampling.sample_texts(vocab, docs, keys, 3)
    for solved in (Solved(vocab), Solved(vocab, most_edges=0)):
        for i, text in enumerate(docs):
            (alone,) = piece_sampling.sample_texts(vocab, [text], keys[i : i + 1], 3, solved)
            assert [(ids.tolist(), p, q) for ids, p, q in alone] == [(ids.tolist(), p, q) for ids, p, q in whole[i]]


FOREIGN = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as e
from parley.session import build_session
spark = build_session("foreign", cpus=8, shuffle_partitions=4)
for name, query in sorted(e.queries().items()):
    if name.startswith("op") or name == "pipeline":
        assert query(spark, "/root/testdata/sf0.001").count() > 0, name
assert spark.range(1).rdd.map(lambda _: __import__("importlib.util").util.find_spec("parley") is None).first()
print("all ran")
"""


def test_queries_run_on_executors_without_a_copy_of_the_package(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    script = tmp_path / "foreign.py"
    script.write_text(FOREIGN.format(repo=str(Path(queries.__file__).resolve().parents[2])))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0 and "all ran" in done.stdout, done.stderr[-3000:]
