"""Exact substring dedup by level-wise doubling.

Windows that repeat at one length alone are extended to twice that length. Texts are packed once into
chunks in a bucketed table in the shared folder; at each level a chunk sends its distinct surviving window hashes,
dealt by hash, and gets back one bit for each of them: whether another chunk has it too. A hash that fills
a third of all texts is thus sent once per chunk, texts are shuffled at no level, and the answers are a
bit per window.
"""

from __future__ import annotations

import random
import uuid
from array import array
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import fresh
from parley.llm.wordhash import WORD_BASE, Powers, U, text_buffers, window_hashes
from parley.session import materialise, shared_folder

CHUNK_BYTES = 4 << 20
#: Text of which one bucket gets the hashes, and chunks that a task writes side by side into one file.
BUCKET_BYTES, FILE_CHUNKS = 64 << 20, 32
#: Bytes of the digest of a word and of a window.
DIGEST = 16


def table_bucket(key: int, buckets: int) -> int:
    """The bucket into which Spark's tables put a long: Murmur3 with seed 42. Any other answer would cost files, not results."""
    mask, h = 0xFFFFFFFF, 42
    rotate = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    for part in (key & mask, (key >> 32) & mask):
        h ^= rotate(part * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
        h = (rotate(h, 13) * 5 + 0xE6546B64) & mask
    h ^= 8
    h = (h ^ (h >> 16)) * 0x85EBCA6B & mask
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return (h - (1 << 32) if h >> 31 else h) % buckets


def number_words(texts):
    """(words of each text, numbers of all words side by side, digests of the distinct words as rows of two longs).

    A word's digest has 128 bits of BLAKE2b, so different words do not meet whatever they hold.
    """
    number: dict[bytes, int] = {}
    flat, counts = array("i"), []
    for text in texts:
        words = text.split()
        counts.append(len(words))
        flat.extend([number.setdefault(w, len(number)) for w in words])
    digests = b"".join([blake2b(w, digest_size=DIGEST).digest() for w in number])
    return np.array(counts, np.int64), np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32), np.frombuffer(digests, np.uint64).reshape(-1, DIGEST // 8)


def word_index(ids, texts):
    """What the levels read of some texts, as Arrow IPC bytes: their ids and what number_words gives."""
    import pyarrow as pa

    counts, number, digests = number_words(texts)
    fields = {"id": ids, "counts": pa.array(counts), "words": pa.array(planes(number)), "digests": pa.array(digests.ravel())}
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in fields.values()], list(fields))
    return ipc_bytes([batch])


def planes(x):
    """The bytes of numbers with equal places side by side, which compress better: the first byte of each, then the second."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).ravel()


def from_planes(x, kind):
    return np.ascontiguousarray(x.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def ipc_bytes(batches) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for batch in batches:
            writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _pack(id_at: int, text_at: int, limit: int, buckets: int):
    """Rows of documents, packed into chunks of about `limit` bytes of text (one row at least), each with its word index."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from pyspark import TaskContext

        made, task = 0, TaskContext.get().partitionId()

        def name():
            """A random number for a chunk, of the table bucket that this task is filling; tasks begin at different ones."""
            nonlocal made
            target = (task + made // FILE_CHUNKS * 7919) % buckets
            made += 1
            while table_bucket(key := random.getrandbits(62), buckets) != target:
                pass
            return key

        def out(parts, size):
            ids = pa.concat_arrays([p.column(id_at).cast(pa.int64()).fill_null(-(2**63)) for p in parts])
            texts = ((t or "").encode() for p in parts for t in p.column(text_at).to_pylist())
            values = {"chunk": pa.array([name()], pa.int64()), "bytes": pa.array([size], pa.int64())}
            return pa.RecordBatch.from_pydict(values | {"payload": pa.array([ipc_bytes(parts)], pa.binary()), "words": pa.array([word_index(ids, texts)], pa.binary())})

        held, size = [], 0
        for batch in batches:
            _, offsets = text_buffers(batch.column(text_at))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit - size, side="right")) - 1)
                held.append(batch.slice(lo, hi - lo))
                size += int(offsets[hi] - offsets[lo])
                lo = hi
                if size >= limit or lo < batch.num_rows:
                    yield out(held, size)
                    held, size = [], 0
        if held:
            yield out(held, size)

    return run


class ChunkLevels:
    """The windows of one chunk, level by level."""

    def __init__(self, levels: list[int], buckets: int):
        self.levels, self.buckets, self.powers = levels, buckets, Powers(WORD_BASE)

    def load(self, words: bytes) -> None:
        """Take up a chunk from its word index."""
        import pyarrow as pa

        index = pa.ipc.open_stream(words).read_next_batch()
        get = lambda name: index.column(name).values.to_numpy()
        self.begin(get("id"), get("counts"), from_planes(get("words"), np.int32), get("digests").reshape(-1, DIGEST // 8))

    def begin(self, ids, counts, number, digests) -> None:
        self.ids, self.counts, self.number, self.digests = ids, counts, number, digests
        self.words = digests[number, 0] if len(number) else np.zeros(0, U)
        self.starts = np.cumsum(counts) - counts
        self.alive = None  # by word: whether the window starting there repeats at the last level applied

    def exact(self, at):
        """(128-bit digests as two arrays) of the windows of the last level that start at `at`: BLAKE2b over their words' digests."""
        if not len(at):
            return np.zeros(0, U), np.zeros(0, U)
        size, width = self.levels[-1], DIGEST
        held = memoryview(self.digests[self.number]).cast("B")
        found = b"".join([blake2b(held[width * i : width * (i + size)], digest_size=width).digest() for i in at.tolist()])
        both = np.frombuffer(found, U).reshape(-1, 2)
        return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])

    def candidates(self, level: int):
        """Sorted distinct hashes of the level's candidate windows, with what is needed to answer for them.

        At the last level a window's hash has 128 bits, in h and more; before it, a hash is a mere filter.
        """
        size, last = self.levels[level], level == len(self.levels) - 1
        h, at, text = window_hashes(self.words, self.counts, size, self.powers)
        if level:
            half = self.levels[level - 1]
            keep = self.alive[at] & self.alive[at + size - half]
            h, at, text = h[keep], at[keep], text[keep]
        h, more = self.exact(at) if last else (h, h)
        bucket = (h & np.uint64(0xFFFFFFFF)) % np.uint64(self.buckets)
        if not last:  # a candidate's hash within its bucket is 32 bits: a chance match costs a candidate, never a result
            h = more = (bucket << np.uint64(32)) | (h >> np.uint64(32))
            order = np.argsort(h, kind="stable")
        else:
            order = np.lexsort((at - self.starts[text], self.ids[text], more, h, bucket))
        h, at, text, bucket, more = h[order], at[order], text[order], bucket[order], more[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (more[1:] != more[:-1])
        group = np.cumsum(new) - 1
        return h, at, text, bucket, np.flatnonzero(new), group, more

    def messages(self, chunk: int, level: int):
        """One row for each bucket: the hashes, and at the last level each one's first place in the chunk."""
        h, at, text, bucket, first, _, more = self.candidates(level)
        last = level == len(self.levels) - 1
        b = bucket[first]
        edges = np.searchsorted(b, np.arange(self.buckets + 1).astype(b.dtype))
        values = h[first] if last else (h[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        ids = self.ids[text[first]]
        starts = (at[first] - self.starts[text[first]]).astype(np.uint32)
        for k in np.flatnonzero(np.diff(edges)):
            lo, hi = edges[k], edges[k + 1]
            yield int(k), chunk, values[lo:hi].tobytes(), *((more[first[lo:hi]].tobytes(), planes(ids[lo:hi]).tobytes(), planes(starts[lo:hi]).tobytes()) if last else (None, None, None))

    def apply(self, level: int, answer) -> None:
        """Take in the answers to a level before the last: which windows stay alive."""
        _, at, _, bucket, first, group, _ = self.candidates(level)
        repeated = self._bits(answer, bucket[first]) | (np.bincount(group, minlength=len(first)) > 1)
        self.alive = np.zeros(len(self.words) + 1, bool)
        self.alive[at[repeated[group]]] = True

    def removed(self, answer):
        """By word: whether a window that also starts earlier covers it."""
        _, at, text, bucket, first, group, _ = self.candidates(len(self.levels) - 1)
        elsewhere = self._bits(answer, bucket[first])
        ids, starts = self.ids[text], at - self.starts[text]
        later = (ids > ids[first][group]) | (starts > starts[first][group])  # sorted by id and start within a hash
        gone = at[later | elsewhere[group]] if len(at) else at
        cover = np.zeros(len(self.words) + 1, np.int64)
        size = self.levels[-1]
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + size, -1)
        return np.cumsum(cover)[:-1] > 0

    def _bits(self, answer, bucket_of_value):
        out = np.zeros(len(bucket_of_value), bool)
        for x in answer if answer is not None else []:
            lo, hi = np.searchsorted(bucket_of_value, np.array([x["bucket"], x["bucket"] + 1]).astype(bucket_of_value.dtype))
            out[lo:hi] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=hi - lo).astype(bool)
        return out


MESSAGE = "bucket int, chunk bigint, vals binary, more binary, ids binary, starts binary"


def _send(levels, buckets, level):
    """Chunks with the answers to the levels before to the messages of this level."""

    def run(frames):
        import pandas as pd

        work = ChunkLevels(levels, buckets)
        for frame in frames:
            for row in frame.itertuples(index=False):
                work.load(row.words)
                for k in range(level):
                    work.apply(k, getattr(row, f"a{k}"))
                rows = list(work.messages(row.chunk, level))
                if rows:
                    yield pd.DataFrame(rows, columns=["bucket", "chunk", "vals", "more", "ids", "starts"])

    return run


def _answer(last: bool):
    """All messages of a bucket to one answer for each chunk, a bit for each of its hashes in order."""

    def run(pdf):
        import pandas as pd

        width = np.uint64 if last else np.uint32
        values = [np.frombuffer(v, width) for v in pdf["vals"]]
        sizes = np.array([len(v) for v in values])
        v = np.concatenate(values)
        if last:
            plane = lambda col, kind: np.concatenate([from_planes(np.frombuffer(x, np.uint8), kind) for x in pdf[col]])
            ids, starts = plane("ids", np.int64), plane("starts", np.uint32)
            more = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["more"]])
            order = np.lexsort((starts, ids, more, v))
        else:
            more, order = v, np.argsort(v, kind="stable")
        s, t = v[order], more[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        bits = np.empty(len(s), bool)
        if last:  # the first place of all is not this chunk's
            bits[order] = (ids[order] != ids[order][first][group]) | (starts[order] != starts[order][first][group])
        else:
            bits[order] = np.bincount(group)[group] > 1
        parts = np.split(bits, np.cumsum(sizes)[:-1])
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "bits": [np.packbits(p).tobytes() for p in parts]})

    return run


def _finish(id_col, text_col, out_names, levels, buckets, extra):
    """Chunks with all answers to their rows, kept text and counts."""

    def run(frames):
        import pyarrow as pa

        work = ChunkLevels(levels, buckets)
        for frame in frames:
            for at in range(frame.num_rows):
                row = frame.slice(at, 1).to_pylist()[0]
                table = pa.ipc.open_stream(row["payload"]).read_all()
                texts = [(t or "").encode() for t in table.column(text_col).to_pylist()]
                ids = table.column(id_col).combine_chunks().cast(pa.int64()).fill_null(-(2**63)).to_numpy()
                work.begin(ids, *number_words(texts))
                for k in range(len(levels) - 1):
                    work.apply(k, row[f"a{k}"])
                gone = work.removed(row[f"a{len(levels) - 1}"])
                kept, n_removed = [], []
                for text, lo, n in zip(texts, work.starts, work.counts, strict=True):
                    words, drop = text.split(), gone[lo : lo + n]
                    n_removed.append(int(drop.sum()))
                    kept.append(b" ".join([w for w, d in zip(words, drop.tolist(), strict=True) if not d] if n_removed[-1] else words).decode())
                for name, values in zip(out_names, (pa.array(kept, pa.string()), pa.array(work.counts, pa.int64()), pa.array(n_removed, pa.int64())), strict=True):
                    table = table.append_column(name, values)
                yield from table.drop_columns(extra).to_batches(max_chunksize=500)

    return run


def _ranked(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """(docs, the name of a column of longs in the order of the ids): the ids themselves, or the ranks of ids of other types."""
    if isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return docs, id_col
    rank, key = fresh(docs, "rank"), fresh(docs, "key")
    ids = docs.select(F.col(f"`{id_col}`").alias(key)).filter(F.col(key).isNotNull()).distinct().orderBy(key)
    ids = materialise(ids.withColumn(rank, F.monotonically_increasing_id()), "substring-ranks")
    return docs.join(ids, docs[id_col] == ids[key], "left").drop(key), rank


def remove_repeats(
    docs: DataFrame, window: int = 20, doublings: int = 2, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str, str] = ("kept_text", "n_words", "n_removed")
) -> DataFrame:
    r"""Remove from every text the words covered by a window of `window` words that starts earlier elsewhere.

    Words are `[^\x20\x09-\x0D]+`, unchanged. Earlier is a smaller id, or the same id and an earlier start;
    windows are judged on the input. Levels run from window / 2^doublings words up to `window`.
    Returns all columns of docs plus `names`: kept words joined by one space, words, removed words.

    Equality of windows, among those both of whose halves repeat, is equality of 128-bit BLAKE2b digests of their words'
    128-bit BLAKE2b digests; the hashes of the shorter levels only choose candidates. A bucket of hashes holds those of about
    BUCKET_BYTES of text, however much there is.

    Null text: no words, kept text empty. Null id: before all others. Ids of any type that sorts. Rows of one id:
    windows at the same start are not earlier than one another, so repeated rows of one id keep what the first
    keeps. Texts below `window` words stay whole. Empty table: empty result. A result replaces a column of its name.
    """
    if window % (1 << doublings):
        raise ValueError("window must be a multiple of 2^doublings")
    taken = {c.lower() for c in names}
    docs = docs.select([c for c in docs.columns if c.lower() not in taken])
    spark, ranked = docs.sparkSession, _ranked(docs, id_col)
    rows, rank = ranked
    extra = [rank] if rank != id_col else []
    levels = [window >> k for k in range(doublings, -1, -1)]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    pack = _pack(rows.columns.index(rank), rows.columns.index(text_col), CHUNK_BYTES, parts)
    packed = rows.mapInArrow(pack, "chunk bigint, bytes bigint, payload binary, words binary")
    name = f"substring_chunks_{uuid.uuid4().hex}"
    packed.write.bucketBy(parts, "chunk").option("compression", "uncompressed").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    # the levels read word indexes alone, the end texts alone
    answered, chunks = spark.table(name).select("chunk", "payload"), spark.table(name).select("chunk", "words")
    total = spark.table(name).agg(F.sum("bytes")).first()[0] or 0
    spark.sql(f"DROP TABLE {name}")  # its files stay, and chunks reads them
    buckets = max(4 * parts, -(-total // BUCKET_BYTES))
    for level in range(len(levels)):
        last = level == len(levels) - 1
        sent = chunks.mapInPandas(_send(levels, buckets, level), MESSAGE)
        replies = sent.groupBy("bucket").applyInPandas(_answer(last), "chunk bigint, bucket int, bits binary")
        replies = materialise(replies, f"substring-level{levels[level]}")
        gathered = replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(f"a{level}"))
        chunks, answered = chunks.join(gathered, "chunk", "left"), answered.join(gathered, "chunk", "left")
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), *[T.StructField(n, T.LongType()) for n in names[1:]]])
    return answered.mapInArrow(_finish(rank, text_col, list(names), levels, buckets, extra), schema)
