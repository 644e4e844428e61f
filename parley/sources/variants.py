"""JSON columns as VARIANT: profiles, attributed spans and insights, decoded where read and encoded where written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decoded(text: Column) -> Column:
    """A JSON text as VARIANT; null where it is malformed."""
    return F.try_parse_json(text)


def encoded(value: Column) -> Column:
    """A VARIANT as JSON text."""
    return F.to_json(value)


def profile_of(value: Column) -> Column:
    """struct(centroid, sample_count) of a stored voice in either historical shape: an object, or a bare list, which counts as one sample.

    Null where the value is neither, or holds something else than numbers.
    """
    bare = F.try_variant_get(value, "$", "array<float>")
    held = F.try_variant_get(value, "$.centroid", "array<float>")
    n = F.coalesce(F.try_variant_get(value, "$.sample_count", "int"), F.lit(1))
    clean = lambda xs: F.when(F.forall(xs, lambda x: x.isNotNull()), xs)
    return F.coalesce(F.when(clean(bare).isNotNull(), F.struct(bare.alias("centroid"), F.lit(1).alias("sample_count"))), F.when(clean(held).isNotNull(), F.struct(held.alias("centroid"), n.alias("sample_count"))))


def profiles(rows: DataFrame, value: str = "profile") -> DataFrame:
    """rows (name and a VARIANT) as name, centroid, sample_count; rows without a usable voice are left out."""
    return rows.select("name", profile_of(F.col(value)).alias("p")).filter("p IS NOT NULL").select("name", "p.*")


def spans(rows: DataFrame, keys: list[str], value: str = "attributed_spans") -> DataFrame:
    """The attributed spans of lines, one row each: keys, span, speaker, speaker_label, text, color. Other shapes have none."""
    each = F.try_variant_get(F.col(value), "$", "array<struct<speaker: string, speaker_label: string, text: string, color: string>>")
    return rows.select(*keys, F.posexplode(each).alias("span", "s")).select(*keys, "span", "s.*")


def insight(value: Column, path: str, kind: str = "string") -> Column:
    """One field of an insights document by its JSON path, or null."""
    return F.try_variant_get(value, path, kind)
