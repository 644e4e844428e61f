"""Numbers, dates, vectors and scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_label(seconds: Column) -> Column:
    """MM:SS, or H:MM:SS from an hour on."""
    s = F.floor(F.greatest(F.coalesce(seconds, F.lit(0)), F.lit(0))).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def duration_label(seconds: Column) -> Column:
    """Xm Ys, or Ys below a minute; rounded."""
    s = F.round(F.greatest(F.coalesce(seconds, F.lit(0)), F.lit(0))).cast("bigint")
    return F.when(s >= 60, F.format_string("%dm %ds", F.floor(s / 60), F.pmod(s, F.lit(60)))).otherwise(F.format_string("%ds", s))


def average_label(seconds: Column) -> Column:
    """N sec, N min or Xm Ys; 0 min for nothing."""
    s = F.round(seconds).cast("bigint")
    whole = F.pmod(s, F.lit(60)) == 0
    return (
        F.when(F.coalesce(s, F.lit(0)) == 0, "0 min").when(s < 60, F.format_string("%d sec", s))
        .when(whole, F.format_string("%d min", F.floor(s / 60))).otherwise(F.format_string("%dm %ds", F.floor(s / 60), F.pmod(s, F.lit(60))))
    )


def bytes_label(size: Column) -> Column:
    """Two decimals of MB, or of GB from 1024 MB on."""
    mb = F.coalesce(size, F.lit(0)) / (1 << 20)
    return F.when(mb >= 1024, F.format_string("%.2f GB", mb / 1024)).otherwise(F.format_string("%.2f MB", mb))


def parse_iso(text: Column, now: Column) -> Column:
    """An ISO instant; without an offset in UTC; `now` where there is none."""
    return F.coalesce(F.try_to_timestamp(text), now)


def display_date(ts: Column) -> Column:
    """A long date, or a dash."""
    return F.coalesce(F.date_format(ts, "MMMM d, yyyy"), F.lit("—"))


def display_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "HH:mm"), F.lit("—"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 with a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def rms(a: Column) -> Column:
    """Root mean square; 0 of nothing."""
    return F.when(F.size(a) > 0, norm(a) / F.sqrt(F.size(a).cast("double"))).otherwise(F.lit(0.0))


def crest_db(a: Column) -> Column:
    """Peak over RMS in decibels; null for silence."""
    peak = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    return F.when(rms(a) > 0, 20 * F.log10(peak / rms(a)))


def clipped_share(a: Column, level: float = 0.99) -> Column:
    """The share of samples at or above a level."""
    return F.when(F.size(a) > 0, F.size(F.filter(a, lambda x: F.abs(x) >= level)) / F.size(a)).otherwise(F.lit(0.0))


def flat_tone(a: Column, threshold: float = 0.002, spread: float = 0.005) -> Column:
    """Whether loudness by second is audible but hardly varies: a hum, not speech. `a` holds RMS by second."""
    n = F.size(a).cast("double")
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / n
    var = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    return (F.size(a) > 0) & (mean >= threshold) & (F.sqrt(var) <= spread)


def renormalise(posterior: Column, allowed: list[str]) -> Column:
    """A map of code to probability restricted to allowed codes, summing to 1; uniform if nothing is left."""
    got = F.transform(F.array(*[F.lit(c) for c in allowed]), lambda c: F.struct(c.alias("code"), F.coalesce(F.try_element_at(posterior, c), F.lit(0.0)).alias("p")))
    total = F.aggregate(got, F.lit(0.0), lambda s, x: s + x["p"])
    return F.transform(got, lambda x: F.struct(x["code"].alias("code"), F.when(total > 0, x["p"] / total).otherwise(F.lit(1 / len(allowed))).alias("p")))


def choose_language(code: Column, prob: Column, hint: Column, strong: float = 0.40, weak: float = 0.25, default: str = "en") -> Column:
    """A sure code; below `strong` the hint, else the code down to `weak`, else the default."""
    return F.when(prob >= strong, code).when(hint.isNotNull(), hint).when(prob >= weak, code).otherwise(F.lit(default))


def margin_and_mixed(ranking: Column, ambiguous: float = 0.15) -> Column:
    """(margin, mixed) of a descending ranking of (code, p): mixed if close and the two lie across the script boundary."""
    first, second = F.try_element_at(ranking, F.lit(1)), F.try_element_at(ranking, F.lit(2))
    gap = F.round(F.coalesce(first["p"] - second["p"], F.lit(1.0)), 3)
    across = (first["code"] == "en") != (second["code"] == "en")
    return F.struct(gap.alias("margin"), F.coalesce((gap < ambiguous) & across, F.lit(False)).alias("mixed"))


def hallucination(no_speech: Column, log_prob: Column, text: Column, duration: Column) -> Column:
    """Why a decode is not to be trusted, or null."""
    n = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return (
        F.when((duration > 0) & (n / duration > 8), "words_per_second")
        .when((no_speech > 0.85) & (log_prob > -1.0), "silent_but_sure")
        .when((no_speech > 0.6) & (log_prob < -1.0) & (log_prob > -1.5), "silent_and_unsure")
    )


def cluster_confidence(count: Column) -> Column:
    """How sure a cluster of that many segments is; half for an unknown one."""
    return F.when(count.isNull(), F.lit(0.5)).otherwise(F.least(count / 20.0, F.lit(1.0)))


def separation_confidence(distance: Column, match: Column, least: float = 0.45) -> Column:
    """(confidence, accepted) of a voice separation."""
    c = F.least((distance + match) / 2, F.lit(1.0))
    return F.struct(c.alias("confidence"), (c >= least).alias("accepted"))


def effective_duration(last_end: Column, *candidates: Column) -> Column:
    """The first positive candidate, else the last line's end."""
    return F.coalesce(*[F.when(c > 0, c) for c in candidates], last_end, F.lit(0.0))


def progress(fraction: Column) -> Column:
    """A fraction as whole percent, cut off."""
    return F.floor(F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0)) * 100).cast("int")


def keep_last(items: Column, most: int = 24) -> Column:
    """The last `most` items of an array."""
    return F.slice(items, F.greatest(F.size(items) - most + 1, F.lit(1)), most)
