"""Column helpers shared by the training-data operators.

Every operator reads only the columns it names, so further columns of any name do no harm;
result columns never include them unless the operator says that it passes rows through.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    r"""Words `[^\x20\x09-\x0D]+` of a text; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged; the quick way where a text is pure ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo: which fold a row belongs to (a null id is folded as empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint when it has at most that many rows; otherwise unhinted, left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def by_value(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A function that gives `value` on an executor, which needs no copy of this package.

    A broadcast pickles classes by name; these bytes hold them by value, as the functions that call this do.
    """
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def load() -> Any:
        from pyspark import cloudpickle

        return cloudpickle.loads(held.value)

    return load
