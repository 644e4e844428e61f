"""Quality classifier: an additive model with pairwise interactions over features of the whole text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import by_value, id_bucket
from parley.llm.gam import Additive, fit_additive

#: At most so many labelled rows are learnt from, those with the smallest id hashes.
FIT_ROWS = 12_000

FEATURES = (
    "log_words", "mean_word", "long_words", "symbols", "upper", "digits", "bangs", "pipes", "non_ascii", "unique_words",
    "top_word", "adjacent_repeats", "dup_lines", "mean_line", "repeat_windows", "ends_in_punctuation", "marks_per_word", "short_words",
)

_SYMBOLS = bytes(b"#*$%&<>{}~^=_\\")


def features(text: str | None) -> list[float]:
    """The features of one text, all counted over the whole of it; all zero for a text without words."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    codes = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = max(1, int(codes.sum() - codes[[9, 10, 11, 12, 13, 32]].sum()))
    lengths = np.fromiter(map(len, words), np.int64, n)
    hashes = np.fromiter(map(hash, words), np.int64, n)
    _, counts = np.unique(hashes, return_counts=True)
    lines = [line for line in data.split(b"\n") if line.strip()]
    letters = int(codes[65:91].sum() + codes[97:123].sum())
    window = 6
    repeats = 0.0
    if n > window and len(counts) < n:
        h = np.zeros(n - window + 1, np.uint64)
        for k in range(window):
            h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - window + 1 + k].view(np.uint64)
        repeats = 1 - len(np.unique(h)) / len(h)
    ends = sum(w[-1] in b".!?,;:" for w in words)
    return [
        float(np.log1p(n)), float(lengths.mean()), float((lengths > 14).mean()), float(codes[list(_SYMBOLS)].sum() / chars), float(codes[65:91].sum() / max(1, letters)),
        float(codes[48:58].sum() / chars), float(codes[33] / n), float(codes[124] / n), float(codes[128:].sum() / chars), len(counts) / n,
        float(counts.max() / n), float((hashes[1:] == hashes[:-1]).mean()) if n > 1 else 0.0, 1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
        repeats, ends / n, float(codes[[33, 44, 46, 58, 59, 63]].sum() / n), float((lengths <= 2).mean()),
    ]


def map_features(docs: DataFrame, text_col: str, start: Callable, schema: T.StructType) -> DataFrame:
    """docs through make(batch, matrix of features), which yields a record batch of the given schema; start() gives each task its make."""
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        make = start()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [features(t) for t in part.column(text_at).to_pylist()]
                yield make(part, np.array(rows).reshape(len(rows), len(FEATURES)))

    return docs.mapInArrow(run, schema)


def labelled_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most `rows` labelled ids (doc_id, y), those with the smallest hashes; an id labelled twice takes its larger label."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The text (text, y, h) of each sampled id, so no more rows than ids; of several texts of one id, the one of least hash h."""
    text = F.col("text").cast("string")
    known = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h")).join(F.broadcast(sample), "doc_id")  # a bounded sample, 12 bytes a row
    return known.groupBy("doc_id").agg(F.min("y").alias("y"), F.min(F.struct("h", "text")).alias("t")).select("t.text", "y", "t.h")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> Additive:
    """Learn from labelled documents, `rows` ids of them at most; docs and labels hold only what may be learnt from."""
    known = labelled_texts(docs, labelled_sample(labels, label, rows))
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("h", T.LongType())])

    def make(part, x):
        import pyarrow as pa

        y, h = (part.column(part.schema.get_field_index(c)) for c in ("y", "h"))
        return pa.RecordBatch.from_arrays([y.cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64())), h], ["y", "x", "h"])

    got = map_features(known, "text", lambda: make, schema).orderBy("h", "y").collect()  # a row for each sampled id
    x = np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES))
    return fit_additive(x, np.array([r["y"] for r in got], float))


def score(docs: DataFrame, model: Additive, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the chance of label 1; a result column replaces one of the same name. Null and empty texts score as no words."""
    docs = docs.select([c for c in docs.columns if c.lower() != out.lower()])
    load = by_value(docs.sparkSession, model)

    def start():
        import pyarrow as pa

        model = load()
        return lambda part, x: pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(x), pa.float64())], [*part.schema.names, out])

    return map_features(docs, text_col, start, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def classify_quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, cut: float = 0.7) -> DataFrame:
    """Fit outside the held-out fold and score every row: doc_id, held_out, score, predicted.

    Labels are learnt only from rows whose crc32(doc_id as text) modulo `modulus` is not `held_out`. Null
    labels and ids teach nothing; with no label at all, or one kind, every score is the (smoothed) prior.
    Null or empty text: scored as a text without words. Repeated rows: one result each. Empty documents:
    empty result. Other columns are not read.
    """
    fold = lambda df: df.filter(id_bucket(F.col("doc_id"), modulus) != held_out)
    model = fit(fold(docs), fold(labels.select("doc_id", "quality")))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (id_bucket(F.col("doc_id"), modulus) == held_out).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
