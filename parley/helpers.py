"""Small helpers shared by the meeting operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def broadcast_bounded(big: DataFrame, stated: DataFrame, key: str, bound: int, join: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """join(big, stated) with `stated` broadcast in blocks of about `bound` rows, so no broadcast grows with it."""
    n = max(1, -(-stated.count() // bound))
    blocks = [stated] if n == 1 else [stated.filter(F.pmod(F.xxhash64(key), F.lit(n)) == b) for b in range(n)]
    return reduce(DataFrame.unionAll, [join(big, F.broadcast(b)) for b in blocks])


def with_fold(df: DataFrame, group: str, order: list[str], reads: list[str], start: Any, step: Callable, name: str, kind: T.DataType) -> DataFrame:
    """df with a column that each group's rows, in order, compute from a running state: step(state, *values) gives (state, value).

    One shuffle by group; rows then stream through sorted partitions, so memory holds a batch and one state, however
    long a group is.
    """
    d = df.repartition(group).sortWithinPartitions(group, *order)
    at = [d.columns.index(c) for c in (group, *reads)]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, state, begun = None, start, False
        for batch in batches:
            out = []
            for k, *values in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                if not begun or k != key:
                    key, state, begun = k, start, True
                state, value = step(state, *values)
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], [*batch.schema.names, name])

    return d.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))
