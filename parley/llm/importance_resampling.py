"""Target-distribution importance resampling with a dictionary of distinct features.

N-gram strings are counted over all documents and all target texts, each distinct string is hashed once, its counts
are added up in its hash bucket, and the buckets' gains come back to the strings and from there to the feature counts
of every document. Documents are counted in chunks of a few megabytes of text: a chunk lists its distinct strings
once, however many of its documents hold them, so a frequent word is one row per chunk and the join back to it
moves no row per document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from parley.llm.common import fresh
from parley.session import materialise

CHUNK_BYTES = 4 << 20
#: A-Z to a-z, other ASCII but digits and a-z to a blank; bytes of longer characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def features_of(text: str | None, most: int) -> tuple[int, list[bytes]]:
    """(words, all runs of 1 to `most` consecutive words joined by one space) of a text."""
    words = (text or "").encode().translate(FOLD).split()
    runs = list(words)
    for n in range(2, most + 1):
        runs += [b" ".join(x) for x in zip(*(words[k:] for k in range(n)), strict=False)]
    return len(words), runs


def _count(most: int, chunk_bytes: int):
    """Rows of (id, text) to one row per chunk: its distinct features with their counts, and its documents' counts by feature number."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from pyspark import TaskContext

        number, made = TaskContext.get().partitionId() << 32, 0

        def out(ids, rows, index):
            totals = np.zeros(len(index), np.int64)
            for _, _, at, times in rows:
                totals[at] += times
            counts = pa.table(
                {
                    "id": pa.chunked_array(ids),
                    "n_words": pa.array([r[0] for r in rows], pa.int64()),
                    "n_features": pa.array([r[1] for r in rows], pa.int64()),
                    "distinct": pa.array([len(r[2]) for r in rows], pa.int64()),
                }
            )
            flat = pa.table({"at": np.concatenate([r[2] for r in rows]), "times": np.concatenate([r[3] for r in rows])})
            packed = []
            for table in (counts, flat):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(table)
                packed.append(sink.getvalue().to_pybytes())
            strings = pa.array([f.decode() for f in index], pa.string())
            return pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([number + made], pa.int64()),
                    "feature": pa.ListArray.from_arrays([0, len(strings)], strings),
                    "n": pa.ListArray.from_arrays([0, len(totals)], pa.array(totals)),
                    "docs": pa.array([packed[0]], pa.binary()),
                    "counts": pa.array([packed[1]], pa.binary()),
                }
            )

        ids, rows, index, size = [], [], {}, 0
        for batch in batches:
            begin = 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                n_words, found = features_of(text, most)
                times = Counter(found)
                at = np.fromiter((index.setdefault(f, len(index)) for f in times), np.int32, len(times))
                rows.append((n_words, len(found), at, np.fromiter(times.values(), np.int32, len(times))))
                size += len(text or "") + 64
                if size >= chunk_bytes:
                    ids.append(batch.column(0).slice(begin, i + 1 - begin))
                    yield out(ids, rows, index)
                    ids, rows, index, size, begin, made = [], [], {}, 0, i + 1, made + 1
            if begin < batch.num_rows:
                ids.append(batch.column(0).slice(begin))
        if rows:
            yield out(ids, rows, index)

    return run


def _weigh(kind):
    """Chunks with the gains of their features to (id, n_words, n_features, weight, chunk, at)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                chunk, gains = batch.column(0)[row], batch.column(3)[row].values
                docs, flat = (pa.ipc.open_stream(batch.column(c)[row].as_buffer()).read_all() for c in (1, 2))
                gain = np.zeros(0, np.int64) if gains is None else gains.to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.concatenate([[0], np.cumsum(gain[flat["at"].to_numpy()] * flat["times"].to_numpy().astype(np.int64))])
                ends = np.cumsum(docs["distinct"].to_numpy())
                total = upto[ends] - upto[ends - docs["distinct"].to_numpy()]
                n = docs["n_features"].to_numpy()
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        docs["id"].combine_chunks().cast(kind), docs["n_words"].combine_chunks(), docs["n_features"].combine_chunks(), pa.array(weight),
                        pa.array(np.full(len(n), chunk.as_py(), np.int64)), pa.array(np.arange(len(n), dtype=np.int64)),
                    ],
                    ["id", "n_words", "n_features", "weight", "chunk", "at"],
                )

    return run


def _chunks(rows: DataFrame, most: int, label: str) -> DataFrame:
    return materialise(rows.mapInArrow(_count(most, CHUNK_BYTES), "chunk bigint, feature array<string>, n array<bigint>, docs binary, counts binary"), label)


def _listed(chunks: DataFrame) -> DataFrame:
    """One row per chunk and distinct feature: chunk, at (its number in the chunk), feature, n."""
    return chunks.select("chunk", F.posexplode(F.arrays_zip("feature", "n")).alias("at", "f")).select("chunk", "at", "f.feature", "f.n")


def feature_dictionary(documents: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(feature, s, t, bucket): each distinct feature's counts in documents and target, hashed once. Both as (feature, n)."""
    none = F.lit(0).cast("bigint")
    both = documents.select("feature", F.col("n").alias("s"), none.alias("t")).unionAll(target.select("feature", none.alias("s"), F.col("n").alias("t")))
    return both.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).withColumn("bucket", F.crc32(F.encode("feature", "UTF-8")) % buckets)


def bucket_gains(dictionary: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of the buckets in use: floor(1000 ln) of how much likelier each is in the target, one added to each count."""
    filled = dictionary.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    total = filled.agg(F.struct((F.sum("s") + buckets).alias("s"), (F.sum("t") + buckets).alias("t")).alias("x")).scalar()
    ratio = ((F.col("t") + 1) * total["s"]) / ((F.col("s") + 1) * total["t"])
    return filled.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("bigint").alias("gain"))


def weigh(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    r"""Importance weights of docs (id, n_words, n_features, weight; chunk and at tell equal rows apart).

    A-Z are lower-cased and words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`; features are all runs of 1 to `most` of them. The
    weight is the mean over a document's features, repeats included, of their buckets' gains, floored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    wanted = target.select(F.lit(0).alias("id"), F.col(f"`{target_col}`").cast("string").alias("text"))
    chunks = _chunks(rows, most, "resampling-chunks")
    aimed = _listed(_chunks(wanted, most, "resampling-target"))
    listed = _listed(chunks)
    dictionary = materialise(feature_dictionary(listed, aimed, buckets), "resampling-dictionary")
    gains = dictionary.join(F.broadcast(bucket_gains(dictionary, buckets)), "bucket").select("feature", "gain")  # one row per bucket at most
    back = listed.select("chunk", "at", "feature").join(gains, "feature").groupBy("chunk").agg(F.collect_list(F.struct("at", "gain")).alias("g"))
    back = back.select("chunk", F.transform(F.array_sort("g"), lambda x: x["gain"]).alias("gains"))
    joined = chunks.select("chunk", "docs", "counts").join(back, "chunk", "left").select("chunk", "docs", "counts", "gains")
    id_type = rows.schema["id"].dataType
    schema = f"id {id_type.simpleString()}, n_words bigint, n_features bigint, weight bigint, chunk bigint, at bigint"
    return joined.mapInArrow(_weigh(to_arrow_type(id_type)), schema)


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 8 hex digits of sha256(`seed:id`); a null id is an empty text."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(hexed, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("bigint")


def globally_ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its place, from 1, in a total order: rows are dealt by ranges and the ranges' sizes give their offsets, so no task sees all."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mark, part, before = (fresh(df, x) for x in ("_mark", "_part", "_before"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(mark, F.monotonically_increasing_id())
    dealt = materialise(dealt, "ranked").withColumn(part, F.shiftright(mark, 33))
    sizes = dealt.groupBy(part).count()
    earlier = F.sum("count").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # one row per range
    sizes = sizes.select(part, F.coalesce(earlier, F.lit(0)).alias(before))
    place = F.col(before) + F.col(mark).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.join(F.broadcast(sizes), part).withColumn(name, place).drop(mark, part, before)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, least_words: int = 20, most: int = 1, buckets: int = 10_000,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """Draw `percent` % of docs, without replacement and with chances by importance for the target, by Gumbel scores.

    Returns for every row its id, n_features, weight (see weigh), score (weight plus a Gumbel number that hangs on seed and id)
    and rank: 1, 2, 3 ... of the floor(percent * N / 100) highest scores among the N rows of `least_words` words or
    more, ties to the smaller id, else null.

    Null text: no features, weight 0, not drawn if least_words is above 0. Null id: scored as an empty id, after all others
    in ties. Repeated rows are scored alike and ranked one after the other. Empty docs: empty result; empty
    target: all its counts are 0. Other columns are not read.
    """
    scored = weigh(docs, target, most, buckets, id_col, text_col, target_col)
    scored = materialise(scored.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "resampling-scores")
    able = F.col("n_words") >= least_words
    # scores are small integers: their histogram tells the least score that can be drawn
    of_score = scored.filter(able).groupBy("score").count()
    above = F.sum("count").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    drawn = of_score.agg((F.sum("count") * percent).alias("n")).select(F.expr("n div 100")).scalar()
    least = of_score.select("score", F.coalesce(above, F.lit(0)).alias("above")).filter(F.col("above") < drawn).agg(F.min("score")).scalar()
    near = F.coalesce(able & (F.col("score") >= least), F.lit(False))
    ranked = globally_ranked(scored.filter(near), [F.desc("score"), F.asc_nulls_last("id"), F.asc("chunk"), F.asc("at")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~near).withColumn("rank", F.lit(None).cast("bigint"))
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionAll(rest.select(columns))


def sample(drawn: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose ids were drawn."""
    ids = drawn.filter(F.col("rank").isNotNull()).select(id_col).distinct()
    return docs.join(ids, docs[id_col].eqNullSafe(ids[id_col]), "left_semi")

