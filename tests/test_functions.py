"""Scalar functions on literal rows, the Devanagari branches among them."""

import pytest
from pyspark.sql import functions as F

from parley.functions import scalar as S
from parley.functions import text as X
from parley.functions import vocabulary as V


def one(spark, column, **values):
    kinds = {k: "string" if isinstance(v, str) or v is None else "double" for k, v in values.items()}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items())) if values else spark.range(1)
    return row.select(column.alias("out")).first()["out"]


def text(spark, f, value, *args):
    return one(spark, f(F.col("t"), *args), t=value)


@pytest.mark.parametrize("t, lang", [
    ("मी उद्या येतो आणि बोलतो", "mr"), ("मैं कल आता हूँ और बोलता हूँ", "hi"), ("mi ghari jato ani bolto", "mr"), ("main kya karta hai aur kaun hai", "hi"),
    ("the main deadline is Friday", "en"), ("mere maze of pan and hum", "en"), ("सलोनी", None), ("", None), ("या तू", None),
])
def test_lexical_language(spark, t, lang):
    assert text(spark, X.lexical_language, t)["language"] == lang


def test_lexical_override_and_recovery(spark):
    d = spark.createDataFrame([("en", "mi ghari jato ani bolto", "hi"), ("en", "plain words only", "hi"), ("hi", "मी उद्या येतो", None)], "l string, t string, h string")
    got = d.select(X.language_override(F.col("l"), F.col("t")).alias("o"), X.recovery_candidates(F.col("l"), F.col("t"), F.col("h")).alias("c")).collect()
    assert [r["o"] for r in got] == ["mr", "en", "mr"] and [r["c"] for r in got] == [["mr", "hi"], [], []]


def test_tokens_keep_devanagari_marks(spark):
    assert text(spark, X.tokens, "मच्छरों की समस्या is BIG ok १२३४।") == ["मच्छरों", "समस्या", "big"]
    assert text(spark, X.words, "It's मराठी, v2!") == ["it", "s", "मराठी", "v2"]


def test_normalise_and_tidy(spark):
    assert text(spark, X.normalise, '  "Hello,   WORLD!" ') == "hello, world"
    assert text(spark, X.tidy, "आज  aahe ಕನ್ನಡ") == "आज आहे।" and text(spark, X.tidy, "hello there") == "hello there." and text(spark, X.tidy, "done!") == "done!"
    assert text(spark, X.tidy, "") == "" and text(spark, X.tidy, None) == "" and text(spark, X.tidy, "aahe") == "aahe."


@pytest.mark.parametrize("raw, clean, ok", [("we ship on monday", "We ship on Monday.", True), ("we ship", "we ship with rockets tomorrow", False), ("", "", True), ("x", "", False)])
def test_faithfulness(spark, raw, clean, ok):
    assert one(spark, X.faithful(F.col("a"), F.col("b")), a=raw, b=clean) is ok


@pytest.mark.parametrize("name, out", [("o'neil", "O'Neil"), ("ANNE-marie.", "Anne-Marie"), ("everyone", None), ("x", None), ("लक्ष्मी", "लक्ष्मी"), ("", None)])
def test_person_name(spark, name, out):
    assert text(spark, X.person_name, name) == out


@pytest.mark.parametrize("t, intro, greet", [
    ("Hello all, my name is priya.", "Priya", None), ("this is ravi speaking", "Ravi", None), ("मेरा नाम सलोनी है", "सलोनी", None), ("माझं नाव अनुष्का आहे", "अनुष्का", None),
    ("Good morning Lakshmi, how are you", None, "Lakshmi"), ("hello everyone", None, None), ("नमस्ते राहुल", None, "राहुल"), ("I am going", None, None),
])
def test_names_in_speech(spark, t, intro, greet):
    assert text(spark, X.introduced_name, t) == intro and text(spark, X.greeted_name, t) == greet


def test_titles_and_files(spark):
    assert text(spark, X.short_title, "um, well, so send the report to the client. Then rest") == "send the report to the client"
    assert text(spark, X.short_title, " ".join(["word"] * 20)) == " ".join(["word"] * 12)
    assert text(spark, X.short_title, "") == "" and text(spark, X.short_title, "okay. Go. Ship it now") == "Ship it now"
    assert text(spark, X.title_from_file, "weekly_sync-call.final.mp3") == "Weekly Sync Call.final" and text(spark, X.title_from_file, ".wav") == "Untitled Meeting"
    assert text(spark, X.extension, "a.B.WAV") == "wav" and text(spark, X.expected_speakers, "x_spk-4.wav") == 4 and text(spark, X.expected_speakers, "x.wav") is None


def test_lists_and_labels(spark):
    assert text(spark, X.csv_to_list, "a, b,,") == ["a", "b"] and text(spark, X.csv_to_list, "a") is None and text(spark, X.csv_to_list, None) is None
    assert text(spark, X.split_composite, "Asha + Ravi&Mo") == ["Asha", "Ravi", "Mo"]
    assert text(spark, X.is_generic, "speaker 12") and not text(spark, X.is_generic, "Speaker_x") and not text(spark, X.is_generic, None)
    assert text(spark, X.is_noise, " [Cough.] ") and text(spark, X.is_noise, "(laughter)") and not text(spark, X.is_noise, "cough up the money")
    assert text(spark, X.nullish, "Not Specified") is None and text(spark, X.nullish, " Friday ") == "Friday"
    assert one(spark, X.display_name(F.col("a"), F.col("b"), F.col("c")), a="Unknown", b="", c="Speaker_01") == "Speaker_01"


def java_hash(s):
    h = 0
    for c in s:
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    return h


@pytest.mark.parametrize("name", ["Asha", "a much longer speaker name", "लक्ष्मी", "Speaker_13"])
def test_palette(spark, name):
    assert text(spark, X.palette_index, name) == (3 if name == "Speaker_13" else abs(java_hash(name)) % 10)


def test_scripts_and_codes(spark):
    mismatch = lambda c, t: one(spark, X.script_mismatch(F.col("c"), F.col("t")), c=c, t=t)
    assert mismatch("hi", "hello there") and not mismatch("hi", "नमस्ते दोस्तों") and mismatch("mr", "123") and not mismatch("en", "hello")
    assert one(spark, X.cloud_language(F.col("c"), F.col("h"), F.col("t")), c="kn-IN", h=None, t="नमस्ते") == ("mr", True)
    assert one(spark, X.script_retry(F.col("c"), F.col("t"), F.col("a")), c="hi", t="latin", a="मराठी") == "मराठी"
    assert one(spark, X.script_retry(F.col("c"), F.col("t"), F.col("a")), c="hi", t="latin", a="latin") == ""
    mix = lambda t, main, *heard: one(spark, X.language_mix(F.array(*[F.lit(h) for h in heard]), F.col("t"), F.col("m")), t=t, m=main)
    assert mix("hello नमस्ते", "hi", "hi") == ["hi", "en"] and mix("hello", "en", "en") is None and mix("hello", "en", "mr", "en") == ["mr", "en"]


def test_summaries_of_any_shape(spark):
    assert text(spark, X.summary_text, '"plain"') == "plain" and text(spark, X.summary_text, '["a", "b"]') == "a b" and text(spark, X.summary_text, '{"overview": "o"}') == "o"
    assert text(spark, X.highlight, "Fooled foo", "FOO") == "<mark>Foo</mark>led <mark>foo</mark>" and text(spark, X.highlight, "a.b", ".") == "a<mark>.</mark>b"
    assert text(spark, X.mask_password, "postgres://me:secret@host/db") == "postgres://me:***@host/db"
    assert text(spark, X.cue, "We decided to ship", V.DECISION_CUES) and not text(spark, X.cue, "rain", V.ACTION_CUES)


@pytest.mark.parametrize("s, time, dur, avg", [(0.0, "00:00", "0s", "0 min"), (59.6, "00:59", "1m 0s", "1 min"), (61.0, "01:01", "1m 1s", "1m 1s"), (3723.2, "1:02:03", "62m 3s", "62m 3s"), (30.0, "00:30", "30s", "30 sec")])
def test_time_labels(spark, s, time, dur, avg):
    assert one(spark, S.time_label(F.col("x")), x=s) == time and one(spark, S.duration_label(F.col("x")), x=s) == dur and one(spark, S.average_label(F.col("x")), x=s) == avg


def test_bytes_and_progress(spark):
    assert one(spark, S.bytes_label(F.lit(5 << 20))) == "5.00 MB" and one(spark, S.bytes_label(F.lit(1 << 30))) == "1.00 GB"
    assert one(spark, S.progress(F.lit(0.999))) == 99 and one(spark, S.keep_last(F.lit([1, 2, 3]), 2)) == [2, 3] and one(spark, S.keep_last(F.lit([1]), 2)) == [1]


def test_vectors(spark):
    a, b = F.lit([3.0, 4.0]), F.lit([4.0, 3.0])
    assert abs(one(spark, S.cosine(a, b)) - 0.96) < 1e-12 and one(spark, S.cosine(a, F.lit([0.0, 0.0]))) == 0 and one(spark, S.unit(a)) == [0.6, 0.8]
    assert abs(one(spark, S.rms(a)) - 12.5**0.5) < 1e-12 and one(spark, S.flat_tone(F.lit([0.01, 0.011]))) and not one(spark, S.flat_tone(F.lit([0.01, 0.2])))


def test_scores(spark):
    ranked = S.renormalise(F.lit({"en": 0.3}) if False else F.create_map(F.lit("en"), F.lit(0.3), F.lit("hi"), F.lit(0.1), F.lit("kn"), F.lit(0.6)), ["en", "hi"])
    assert [tuple(r) for r in one(spark, ranked)] == [("en", pytest.approx(0.75)), ("hi", pytest.approx(0.25))]
    close = F.array(F.struct(F.lit("en").alias("code"), F.lit(0.5).alias("p")), F.struct(F.lit("hi").alias("code"), F.lit(0.4).alias("p")))
    assert tuple(one(spark, S.margin_and_mixed(close))) == (0.1, True)
    reason = lambda n, p, t, d: one(spark, S.hallucination(F.col("n"), F.col("p"), F.col("t"), F.col("d")), n=n, p=p, t=t, d=d)
    assert reason(0.1, -0.2, "a " * 20, 1.0) == "words_per_second" and reason(0.9, -0.5, "hi", 2.0) == "silent_but_sure" and reason(0.7, -1.2, "hi", 2.0) == "silent_and_unsure"
    assert reason(0.94, -1.66, "quiet speech", 2.0) is None and reason(0.1, -0.1, "fine", 2.0) is None
    pick = lambda p, h: one(spark, S.choose_language(F.lit("mr"), F.lit(p), F.lit(h).cast("string")))
    assert (pick(0.5, "hi"), pick(0.3, "hi"), pick(0.3, None), pick(0.1, None)) == ("mr", "hi", "mr", "en")
