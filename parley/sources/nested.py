"""Nested meeting records shredded by their schema into a row for each meeting and a table for each list of children."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LINE = _struct(
    start_sec=_D, end_sec=_D, time=_S, speaker=_S, speaker_label=_S, identified_as=_S, confidence=_D, color=_S, language=_S, is_overlap=_B, candidate_speakers=T.ArrayType(_S), raw_text=_S, text=_S
)
#: A meeting record as it is exchanged; names in camel case become snake case.
RECORD = _struct(
    id=_S, title=_S, agenda=_S, fileName=_S, fileType=_S, fileSizeBytes=T.LongType(), uploadedAtISO=T.TimestampType(), status=_S, progress=_I, duration=_S, durationSeconds=_D, participants=_I,
    language=_S, summary=_S, insights=_S, languages=T.ArrayType(_struct(code=_S, name=_S, seconds=_D, pct=_D)), speakerStats=T.ArrayType(_struct(name=_S, seconds=_D, time=_S, pct=_D, color=_S)),
    transcript=T.ArrayType(LINE), decisions=T.ArrayType(_struct(text=_S, quote=_S)), actionItems=T.ArrayType(_struct(title=_S, assignee=_S, due=_S, quote=_S)), keywords=T.ArrayType(_S),
)


def snake(name: str) -> str:
    """camelCase, also with runs of capitals, to snake_case: fileName to file_name, uploadedAtISO to uploaded_at_iso."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def _kept(field: T.StructField, column: Column) -> Column:
    return column.alias(snake(field.name))


def parse(raw: DataFrame, json_col: str = "value", schema: T.StructType = RECORD) -> DataFrame:
    """One struct column `record` for each JSON text that holds a record with an id; others are left out."""
    d = raw.select(F.from_json(json_col, schema).alias("record"))
    return d.filter(F.trim(F.coalesce(F.col("record.id"), F.lit(""))) != "")


def shred(records: DataFrame, schema: T.StructType = RECORD, key: str = "id") -> dict[str, DataFrame]:
    """`meetings` and, under the snake case of each list's name, its rows: meeting_id, position and the element's fields (value for a scalar).

    The schema decides what is a child: every field that is a list. A missing and an empty list have no rows. Of records with
    one id the first by content stays, so children of two versions do not mix.
    """
    first = records.groupBy(F.col(f"record.{key}").alias("k")).agg(F.min(F.struct(F.to_json("record").alias("text"), "record")).alias("r")).select("r.record")
    plain = [f for f in schema if not isinstance(f.dataType, T.ArrayType)]
    out = {"meetings": first.select([_kept(f, F.col(f"record.{f.name}")) for f in plain])}
    for f in schema:
        if isinstance(f.dataType, T.ArrayType):
            rows = first.select(F.col(f"record.{key}").alias("meeting_id"), F.posexplode(f"record.{f.name}").alias("position", "x"))
            inner = f.dataType.elementType
            fields = [_kept(g, F.col(f"x.{g.name}")) for g in inner] if isinstance(inner, T.StructType) else [F.col("x").alias("value")]
            out[snake(f.name)] = rows.select("meeting_id", "position", *fields)
    return out


def assemble(tables: dict[str, DataFrame], schema: T.StructType = RECORD, key: str = "id") -> DataFrame:
    """The records that the tables make up again: one JSON text (id, value) for each meeting, children in order of position."""
    d = tables["meetings"]
    columns = [F.col(snake(f.name)).alias(f.name) for f in schema if not isinstance(f.dataType, T.ArrayType)]
    for f in schema:
        if isinstance(f.dataType, T.ArrayType):
            name, inner = snake(f.name), f.dataType.elementType
            element = F.struct([F.col(snake(g.name)).alias(g.name) for g in inner]) if isinstance(inner, T.StructType) else F.col("value")
            held = F.array_sort(F.collect_list(F.struct("position", element.alias("x"))))
            lists = tables[name].groupBy(F.col("meeting_id").alias(snake(key))).agg(F.transform(held, lambda s: s["x"]).alias(f"_{name}"))
            d = d.join(lists, snake(key), "left")
            columns.append(F.col(f"_{name}").alias(f.name))
    return d.select(F.col(snake(key)).alias("id"), F.to_json(F.struct(columns)).alias("value"))


def child_differences(source: dict[str, DataFrame], stored: dict[str, DataFrame], children: list[str]) -> DataFrame:
    """Meetings of the source whose numbers of children differ in the store: id, child, in_source, in_store."""
    out = None
    for name in children:
        count = lambda t, c: t[name].groupBy(F.col("meeting_id").alias("id")).agg(F.count("*").alias(c))  # noqa: B023, E731
        d = source["meetings"].select("id").join(count(source, "in_source"), "id", "left").join(count(stored, "in_store"), "id", "left").fillna(0, ["in_source", "in_store"])
        d = d.filter("in_source <> in_store").select("id", F.lit(name).alias("child"), "in_source", "in_store")
        out = d if out is None else out.unionAll(d)
    return out
