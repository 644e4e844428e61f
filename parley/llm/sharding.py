"""Sharding by jump consistent hashing (Lamping and Veach): stable keys to shards without a ring table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import broadcast_if_small, fresh
from parley.session import materialise

# Fixed values of the published algorithm: multiplier of its generator and the word size.
MULTIPLIER = 2862933555777941757
TWO_64 = 1 << 64


def stable_key(column: Column, kind: str) -> Column:
    """An unsigned 64-bit key: integers by their own bits, anything else by XXH64 of its text; null as zero."""
    bits = column.cast("bigint") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(column.cast("string"))
    wide = F.coalesce(bits, F.lit(0)).cast("decimal(38,0)")
    return F.when(wide < 0, wide + F.lit(str(TWO_64)).cast("decimal(38,0)")).otherwise(wide).cast("decimal(38,0)")


def with_jump_shards(rows: DataFrame, key: str, shards: int, out: str, first_steps: int = 32) -> DataFrame:
    """rows with a struct `out` of shard, among `shards`, and grown, among one more; `key` names a column of stable_key.

    One pass of the generator serves both: the jumps do not depend on the number of shards, so the shard is the
    last jump below the limit. A key needs about log(shards) jumps, so `first_steps` are tried first, and only keys
    still under way go on, up to the shards + 1 jumps that no key exceeds. Decimals keep the 64-bit product exact.
    """
    jump = "cast(floor((t.b + 1) * (2147483648D / ((t.k div 8589934592BD) + 1))) as bigint)"
    step = f"cast((t.k * {MULTIPLIER}BD + 1BD) % {TWO_64}BD as decimal(38,0))"
    taken = f"named_struct('k', {step}, 'b', {jump}, 's', if({jump} < {shards}, {jump}, t.s), 'on', true)"
    halted = "named_struct('k', t.k, 'b', t.b, 's', t.s, 'on', false)"
    run = lambda n, start: f"aggregate(sequence(1, {n}), {start}, (t, i) -> if(not t.on, t, if({jump} < {shards + 1}, {taken}, {halted})))"
    begin, state = f"named_struct('k', `{key}`, 'b', -1L, 's', 0L, 'on', true)", fresh(rows, "_state")
    d = rows.withColumn(state, F.expr(run(min(first_steps, shards + 1), begin)))
    if first_steps < shards + 1:
        d = d.withColumn(state, F.expr(f"if({state}.on, {run(shards + 1, state)}, {state})"))
    both = F.struct(F.col(state)["s"].cast("int").alias("shard"), F.col(state)["b"].cast("int").alias("grown"))
    return d.withColumn(out, both).drop(state)


def assign_shards(docs: DataFrame, shards: int = 40, key_col: str = "doc_id", text_col: str = "text", part_rows: int = 200_000) -> DataFrame:
    """Shard, slot and the shard under one more shard for every row of docs.

    Returns the key column, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard, slot, grown_shard.
    Slots count from 0 without gaps within a shard. Counting is in two levels: each shard is cut into parts of
    about `part_rows` rows, 64 at least, by key plus checksum, and the parts' sizes give their offsets, so no task
    ranks a whole shard and rows of one key with different texts still spread. Within a part the order is by key,
    checksum and size.

    Null key: placed as key 0. Null text: size 16, null checksum. Repeated rows get a slot each. Empty
    table: empty result. Other columns are not read.
    """
    kind = dict(docs.dtypes)[key_col]
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(
        F.col(f"`{key_col}`").alias("_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint").alias("_size"),
        F.crc32(text).alias("_crc"),
        stable_key(F.col(f"`{key_col}`"), kind).alias("_key"),
    )
    placed = with_jump_shards(rows, "_key", shards, "_both")
    mixed = (F.col("_key") + F.coalesce("_crc", F.lit(0))).cast("decimal(38,0)")
    placed = materialise(placed.select("_id", "_size", "_crc", F.col("_both.shard").alias("_shard"), F.col("_both.grown").alias("_grown"), mixed.alias("_mixed")), "shards")
    spread = max(64, -(-placed.count() // (shards * part_rows)))
    placed = placed.withColumn("_part", (F.col("_mixed") % F.lit(spread)).cast("bigint"))
    before = Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_shard", "_part").count().select("_shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_shard", "_part").orderBy("_id", "_crc", "_size"))
    return placed.join(broadcast_if_small(offsets, 100_000), ["_shard", "_part"]).select(
        F.col("_id").alias(key_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_offset") + rank - 1).cast("bigint").alias("slot"),
        F.col("_grown").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, key_col: str = "doc_id") -> None:
    """Write docs partitioned by shard; rows of a shard come from many tasks, each adding its own file. A column `shard` is replaced."""
    key, both = fresh(docs, "_key"), fresh(docs, "_both")
    keyed = docs.withColumn(key, stable_key(F.col(f"`{key_col}`"), dict(docs.dtypes)[key_col]))
    placed = with_jump_shards(keyed, key, shards, both)
    placed.withColumn("shard", F.col(both)["shard"]).drop(key, both).write.partitionBy("shard").parquet(path)
