"""Rows that fail kept apart from rows that work, so that one bad row stops no stream and no row is lost."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What bad data may raise; anything else is a fault of the code and stops the stream.
EXPECTED = (ValueError,)


def with_errors(df: DataFrame, work: Callable, reads: list[str], kind: str, name: str = "value", expected: tuple = EXPECTED) -> DataFrame:
    """df with `name`, the value of work(*reads) of each row, and `error`, why there is none; either is null."""
    at = [df.columns.index(c) for c in reads]
    field = T.StructField(name, T._parse_datatype_string(kind))
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(field.dataType)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            values, errors = [], []
            for args in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                try:
                    value, error = work(*args), None
                except expected as e:
                    value, error = None, f"{type(e).__name__}: {e}"
                values.append(value)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow), pa.array(errors, pa.string())], [*batch.schema.names, name, "error"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, field, T.StructField("error", T.StringType())]))


def split_sinks(checked: DataFrame, good: str, bad: str, checkpoint: str):
    """A stream of rows with `error` written to two Parquet folders: what works to good, the rest, with its reason, to bad.

    Both parts of a batch lie in a folder of the batch's number, written over when a batch is repeated.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            batch.filter("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
            failed = batch.filter("error IS NOT NULL").withColumn("failed_at", F.current_timestamp())
            failed.write.mode("overwrite").parquet(f"{bad}/batch={batch_id}")
        finally:
            batch.unpersist()

    return checked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
