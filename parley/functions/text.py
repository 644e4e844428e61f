"""Scalar text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions import vocabulary as V

DEVANAGARI_WORD = r"ऀ-ॣॱ-ॿ"
GENERIC_LABEL = r"(?i)^speaker[_\s]?\d+$"
STRIP = " .,!?-\"'।"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def tokens(text: Column) -> Column:
    """Runs of three or more Latin or Devanagari letters (marks included), lower-cased."""
    return F.regexp_extract_all(F.lower(_text(text)), F.lit(rf"[A-Za-z{DEVANAGARI_WORD}]{{3,}}"), F.lit(0))


def words(text: Column) -> Column:
    """Tokens for whole-token search: lower-cased runs of letters and digits in any script, marks kept."""
    return F.filter(F.split(F.lower(_text(text)), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def normalise(text: Column) -> Column:
    """Lower case, outer punctuation stripped, inner white space collapsed."""
    return F.regexp_replace(F.btrim(F.lower(_text(text)), F.lit(STRIP)), r"\s+", " ")


def collapse(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.btrim(F.regexp_replace(_text(text), r"\s+", " "))


def letters(text: Column, kind: str) -> Column:
    """How many Devanagari or Latin letters a text has."""
    keep = {"devanagari": r"[^ऀ-ॿ]", "latin": "[^A-Za-z]"}[kind]
    return F.length(F.regexp_replace(_text(text), keep, ""))


def strip_foreign(text: Column) -> Column:
    """Scripts outside Latin and Devanagari that speech models invent are removed."""
    return collapse(F.regexp_replace(_text(text), V.FOREIGN_SCRIPTS, ""))


def tidy(text: Column) -> Column:
    """Light clean-up: foreign scripts out, romanised words beside Devanagari restored, a closing mark where none stands."""
    t = strip_foreign(text)
    mixed = reduce(lambda c, kv: F.regexp_replace(c, rf"(?i)\b{kv[0]}\b", kv[1]), V.ROMANISED.items(), t)
    t = F.when(t.rlike(r"[ऀ-ॿ]"), mixed).otherwise(t)
    closed = t.rlike("[.!?…।]$") | (t == "")
    return F.when(closed, t).when(letters(t, "devanagari") > F.length(t) * 0.3, F.concat(t, F.lit("।"))).when(t.rlike("[A-Za-z]"), F.concat(t, F.lit("."))).otherwise(t)


def subset_tokens(text: Column) -> Column:
    """Distinct lower-cased Devanagari runs and Latin words with digits and apostrophes."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_text(text)), F.lit(r"[ऀ-ॿ]+|[A-Za-z0-9']+"), F.lit(0)))


def faithful(raw: Column, cleaned: Column, limit: float = 0.08) -> Column:
    """Whether a cleaned text adds almost no words: at most `limit` of its tokens are new and longer than two characters."""
    new = F.filter(F.array_except(subset_tokens(cleaned), subset_tokens(raw)), lambda w: F.length(w) > 2)
    n = F.size(subset_tokens(cleaned))
    return F.when(F.btrim(_text(cleaned)) == "", F.btrim(_text(raw)) == "").when(n == 0, True).otherwise(F.size(new) / n <= limit)


def _hits(found: Column, vocabulary: list[str]) -> Column:
    return F.size(F.filter(found, lambda w: w.isin(vocabulary)))


def lexical_language(text: Column) -> Column:
    """(language, confidence): Hindi against Marathi by closed-class words; English if Latin without any; null if undecided."""
    found = F.filter(F.split(F.lower(_text(text)), V.WORD_BREAK), lambda w: w != "")
    deva = _text(text).rlike(r"[ऀ-ॿ]")
    mr = F.when(deva, _hits(found, V.MARATHI)).otherwise(_hits(found, V.MARATHI_ROMAN))
    hi = F.when(deva, _hits(found, V.HINDI)).otherwise(_hits(found, V.HINDI_ROMAN))
    total = mr + hi
    code = F.when(F.size(found) == 0, None).when((total == 0) & ~deva, "en").when((total == 0) | (mr == hi), None).when(mr > hi, "mr").otherwise("hi")
    return F.struct(code.alias("language"), F.when((F.size(found) > 0) & (total > 0), F.abs(mr - hi) / total).otherwise(F.lit(0.0)).alias("confidence"))


def language_override(current: Column, text: Column, floor: float = 0.34) -> Column:
    """The language a text itself speaks for, where it is Hindi or Marathi, clear enough and not the current one."""
    guess = lexical_language(text)
    return F.when(guess["language"].isin("hi", "mr") & (guess["confidence"] >= floor) & ~guess["language"].eqNullSafe(current), guess["language"]).otherwise(current)


def script_mismatch(code: Column, text: Column, least: float = 0.35) -> Column:
    """Whether a text claimed to be Hindi or Marathi has too few Devanagari letters."""
    every = F.length(F.regexp_replace(_text(text), r"[^\p{L}]", ""))
    deva = F.length(F.regexp_replace(_text(text), r"[^\p{L}]|[^ऀ-ॿ]", ""))
    return code.isin("hi", "mr") & ((every == 0) | (deva / F.greatest(every, F.lit(1)) < least))


def recovery_candidates(code: Column, text: Column, hint: Column, floor: float = 0.34) -> Column:
    """For English lines that read as romanised Hindi or Marathi: the languages to decode again in; else empty."""
    guess = lexical_language(text)
    other = F.coalesce(F.when(hint.isin("hi", "mr"), hint), F.when(guess["language"] == "hi", "mr").otherwise("hi"))
    found = F.array_distinct(F.array(guess["language"], other))
    return F.when((code == "en") & guess["language"].isin("hi", "mr") & (guess["confidence"] >= floor), found).otherwise(F.array().cast("array<string>"))


def script_retry(code: Column, text: Column, alternative: Column) -> Column:
    """A text whose script contradicts its language gives way to the other language's decode, else to nothing."""
    other = F.when(code == "hi", "mr").otherwise("hi")
    return F.when(~script_mismatch(code, text), text).when(~script_mismatch(other, alternative) & alternative.isNotNull(), alternative).otherwise(F.lit(""))


def is_generic(label: Column) -> Column:
    """Labels such as Speaker_03, which name nobody."""
    return F.coalesce(label, F.lit("")).rlike(GENERIC_LABEL)


def is_noise(text: Column) -> Column:
    """Texts that are one sound in words, perhaps in brackets."""
    return F.btrim(_text(text)).rlike(rf"(?i)^\s*\(?\[?\s*({'|'.join(V.SOUNDS)})\.?\s*\]?\)?\s*$")


def is_short_filler(text: Column, seconds: Column, below: float = 1.8) -> Column:
    """Whether a short line is one of the fillers that speech models make up; a flag, since nothing is dropped for it."""
    plain = F.rtrim(F.lower(F.btrim(_text(text))), F.lit(".!?,"))
    return (seconds < below) & plain.isin(V.SHORT_FILLERS)


def script_bucket(language: Column, text: Column) -> Column:
    """Which summary a line goes into: mr or hi if Devanagari prevails, en if there is a Latin letter, else none."""
    marathi = F.exists(F.array(*[F.lit(m) for m in V.MARATHI_MARKERS]), lambda m: F.contains(_text(text), m)) | F.lower(_text(language)).isin("mr", "mr-in")
    more = letters(text, "devanagari") > letters(text, "latin")
    return F.when(more & marathi, "mr").when(more, "hi").when(letters(text, "latin") > 0, "en")


def upload_problems(name: Column, size: Column, most_mb: int = 300) -> Column:
    """What is wrong with an uploaded file: type, size cap, emptiness; an empty list if nothing is."""
    found = F.array(
        F.when(~extension(name).isin(V.UPLOAD_TYPES), "type not allowed"), F.when(size > most_mb * (1 << 20), "too large"), F.when(F.coalesce(size, F.lit(0)) == 0, "empty")
    )
    return F.filter(found, lambda x: x.isNotNull())


def decision_shape(raw: Column) -> Column:
    """(text, quote, source_time) of a decision given as an object in JSON or as a bare string."""
    obj = F.from_json(raw, "struct<text:string, quote:string, sourceTime:string>")
    is_object = F.ltrim(_text(raw)).startswith("{") & obj.isNotNull()
    return F.struct(
        F.when(is_object, F.coalesce(obj["text"], F.lit(""))).otherwise(_text(raw)).alias("text"),
        F.when(is_object, obj["quote"]).alias("quote"), F.when(is_object, obj["sourceTime"]).alias("source_time"),
    )


def display_of(name: Column, known: Column) -> Column:
    """A raw name as shown: each part of a composite that `known` (label or name in lower case to name) has, by that name."""
    shown = lambda x: F.coalesce(F.try_element_at(known, F.lower(F.btrim(x))), F.btrim(x))
    parts = F.transform(split_composite(name), shown)
    return F.when(F.btrim(_text(name)) == "", "Speaker_00").when(name.rlike(r"\+|&"), F.array_join(parts, " + ")).otherwise(shown(name))


def split_composite(name: Column) -> Column:
    """The people in a composite name, joined by + or &."""
    return F.filter(F.transform(F.split(_text(name), r"\s*(?:\+|&)\s*"), lambda x: F.btrim(x)), lambda x: x != "")


def display_name(identified: Column, speaker: Column, label: Column) -> Column:
    """An identified name unless it is the sentinel, else the speaker, else the label."""
    known = (F.coalesce(identified, F.lit("")) != "") & (normalise(identified) != "unknown")
    return F.when(known, identified).otherwise(F.coalesce(F.nullif(speaker, F.lit("")), label))


def person_name(raw: Column) -> Column:
    """A name without outer punctuation, title-cased if Latin; null for words that name nobody."""
    name = F.btrim(_text(raw), F.lit(" .,!?;:'\""))
    # every letter after a non-letter is a capital, so o'neil and anne-marie come out as people write them
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}]+|[^\p{L}]+"), F.lit(0))
    titled = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, F.lit(2), F.length(p)))), "")
    rejected = (F.length(name) < 2) | F.lower(name).isin(V.NOT_NAMES)
    return F.when(rejected, None).when(name.rlike("[A-Za-z]"), titled).otherwise(name)


def _first_name(text: Column, patterns: list[str]) -> Column:
    found = [person_name(F.nullif(F.regexp_extract(_text(text), p, 1), F.lit(""))) for p in patterns]
    return F.coalesce(*found)


def introduced_name(text: Column) -> Column:
    """The name by which a text introduces its speaker."""
    return _first_name(text, V.INTRODUCTIONS)


def greeted_name(text: Column) -> Column:
    """The name that a text greets."""
    return _first_name(text, V.GREETINGS)


def short_title(text: Column, most: int = 12) -> Column:
    """A title: leading fillers gone, the first sentence of two words or more, at most `most` words."""
    filler = "|".join(V.FILLERS)
    t = F.regexp_replace(F.btrim(_text(text)), rf"(?i)^(?:(?:{filler})[,\s.\-]+)+", "")
    t = F.regexp_replace(F.btrim(t), r"^[^a-zA-Zऀ-ॿ]+", "")
    sentences = F.filter(F.transform(F.split(t, "[.!?]+"), lambda s: F.btrim(s)), lambda s: s != "")
    longer = F.filter(sentences, lambda s: F.size(F.split(s, r"\s+")) >= 2)
    t = F.coalesce(F.try_element_at(longer, F.lit(1)), F.try_element_at(sentences, F.lit(1)), t)
    w = F.split(t, r"\s+")
    cut = F.concat(F.regexp_replace(F.array_join(F.slice(w, 1, most), " "), r"[.,;:\-]+$", ""), F.lit("..."))
    return F.btrim(F.when(F.size(w) > most, cut).otherwise(t), F.lit(" .,;:-"))


def title_from_file(name: Column, default: str = "Untitled Meeting") -> Column:
    """A title from a file name: extension off, _ and - as blanks, words capitalised."""
    stem = collapse(F.regexp_replace(F.regexp_replace(_text(name), r"\.[^.]*$", ""), "[_-]+", " "))
    return F.when(stem == "", default).otherwise(F.initcap(stem))


def extension(name: Column) -> Column:
    """The last suffix of a file name, lower-cased, without the dot."""
    return F.lower(F.regexp_extract(_text(name), r"\.([^.]+)$", 1))


def csv_to_list(text: Column) -> Column:
    """A comma-joined list; fewer than two entries are no list."""
    items = F.filter(F.transform(F.split(_text(text), ","), lambda x: F.btrim(x)), lambda x: x != "")
    return F.when(F.size(items) >= 2, items)


def list_to_csv(items: Column) -> Column:
    """The reverse of csv_to_list."""
    kept = F.filter(F.transform(items, lambda x: F.btrim(x)), lambda x: x != "")
    return F.when(F.size(kept) >= 2, F.array_join(kept, ","))


def truncate(text: Column, most: int = 60) -> Column:
    """The first `most` characters and three dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def nullish(text: Column) -> Column:
    """Text, or null where a model wrote that there is none."""
    return F.when(F.lower(F.btrim(_text(text))).isin(V.NULLISH), None).otherwise(F.btrim(text))


def cue(text: Column, phrases: list[str]) -> Column:
    """Whether any cue phrase occurs."""
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.lower(_text(text)), p))


def palette_index(name: Column, size: int = 10) -> Column:
    """A palette slot: numeric labels by their number, other names by a 32-bit rolling hash of their UTF-16 units."""
    # h * 31 + c in signed 32-bit arithmetic, kept exact in 64 bits
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    chars = F.filter(F.split(_text(name), ""), lambda c: c != "")
    h = F.aggregate(chars, F.lit(0).cast("bigint"), lambda a, c: wrap(a * 31 + F.ascii(c)))
    number = F.regexp_extract(_text(name), r"(\d+)$", 1)
    return F.when(is_generic(name), F.pmod(number.cast("bigint"), F.lit(size))).otherwise(F.pmod(F.abs(h), F.lit(size))).cast("int")


def expected_speakers(file_name: Column) -> Column:
    """The speaker count that a file name states."""
    return F.nullif(F.regexp_extract(F.lower(_text(file_name)), r"spk[-_\s]?(\d+)", 1), F.lit("")).cast("int")


def mask_password(url: Column) -> Column:
    """A connection URL with its password hidden."""
    return F.regexp_replace(url, r"(://[^:/@]+:)[^@]*@", "$1***@")


def highlight(text: Column, needle: str) -> Column:
    """Every occurrence of the needle, whatever its case, between marks."""
    if not needle.strip():
        return text
    quoted = needle.strip().replace("\\E", "\\E\\\\E\\Q")
    return F.regexp_replace(text, F.lit(f"(?i)(\\Q{quoted}\\E)"), F.lit("<mark>$1</mark>"))


def window_text(time: str, speaker: str, text: str, lines: Column) -> Column:
    """Lines of a window, each as [time] speaker: text."""
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("["), F.coalesce(x[time], F.lit("")), F.lit("] "), F.coalesce(x[speaker], F.lit("?")), F.lit(": "), F.coalesce(x[text], F.lit("")))), "\n")


def overlap_text(spans: Column) -> Column:
    """Attributed spans as speaker: text, joined by slashes."""
    full = F.filter(spans, lambda s: F.btrim(F.coalesce(s["text"], F.lit(""))) != "")
    return F.array_join(F.transform(full, lambda s: F.concat(s["speaker"], F.lit(": "), s["text"])), " / ")


def language_mix(heard: Column, text: Column, main: Column) -> Column:
    """Languages in first-heard order, with those that the scripts show; null if there is only one."""
    both = (letters(text, "devanagari") > 0) & (letters(text, "latin") > 0)
    indic = F.when(main.isin("hi", "mr"), main).otherwise("mr")
    mix = F.when(both, F.array_union(heard, F.array(F.lit("en"), indic))).otherwise(F.array_distinct(heard))
    return F.when(F.size(mix) > 1, mix)


def cloud_language(code: Column, hint: Column, text: Column, default: str = "en") -> Column:
    """(code, fallback): a BCP-47 code as two letters if allowed; Devanagari text of another language is Marathi."""
    two = F.lower(F.substring_index(_text(code), "-", 1))
    known = two.isin("en", "hi", "mr")
    base = F.when(known, two).otherwise(F.coalesce(hint, F.lit(default)))
    fixed = F.when(_text(text).rlike(r"[ऀ-ॿ]") & ~base.isin("hi", "mr"), "mr").otherwise(base)
    return F.struct(fixed.alias("language"), (~known).alias("fallback"))


def summary_text(raw: Column) -> Column:
    """The summary in a model's answer, be it a string, a list of strings or an object with one under a usual key."""
    obj = F.from_json(raw, "struct<summary:string, text:string, overview:string, en:string>")
    items = F.from_json(raw, "array<string>")
    first = F.substring(F.ltrim(_text(raw)), 1, 1)
    return F.when(first == "{", F.coalesce(obj["summary"], obj["text"], obj["overview"], obj["en"])).when(first == "[", F.array_join(items, " ")).otherwise(F.btrim(raw, F.lit(' "')))


def export_line(time: Column, speaker: Column, language: Column, text: Column) -> Column:
    """A transcript export's line."""
    return F.concat(F.lit("["), time, F.lit("] "), speaker, F.lit(" ("), language, F.lit("): "), text)
