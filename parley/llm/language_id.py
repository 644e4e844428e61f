"""Language ID with a string kernel.

A text is the set of its character n-grams of lengths 1 to 3, hashed to a bitmap; the blended-spectrum
presence kernel of two texts is the size of the bitmaps' intersection over the geometric mean of their
sizes. Nystroem landmarks turn it into a short feature vector, and one-versus-rest kernel ridge regression
on these gives a score per language. Scoring is three matrix products per batch of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import by_value, id_bucket

UND = "und"


@dataclass(frozen=True)
class Settings:
    """Bounds and parameters of the fit: of each language at most per_language texts, of all languages together about fit_rows."""

    dims: int = 1 << 14
    longest: int = 3
    per_language: int = 500
    landmarks: int = 192
    fit_rows: int = 100_000
    ridge: float = 1e-2
    sharpness: float = 3.0


class Bitmaps:
    """Bitmaps of n-gram presence; letters are lower-cased, runs of anything else are one blank."""

    def __init__(self, dims: int, longest: int, piece: int = 1 << 18):
        self.dims, self.longest, self.piece = dims, longest, piece
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)

    def fill(self, text: str | None, bits) -> bool:
        """Set the bits of a text; false if it has no letter. Long texts go by in pieces that overlap by an n-gram."""
        found, text = False, text or ""
        for lo in range(0, len(text), self.piece):
            codes = np.frombuffer(text[max(0, lo - self.longest) : lo + self.piece].lower().encode("utf-32-le", "replace"), np.uint32)
            letters = self.letter[codes]
            if not letters.any():
                continue
            found = True
            codes = np.where(letters, codes, np.uint32(32))
            keep = np.empty(len(codes), bool)
            keep[0], keep[1:] = True, letters[1:] | letters[:-1]
            codes = codes[keep]
            gram = np.zeros(len(codes), np.uint32)
            for n in range(1, self.longest + 1):
                gram = gram[: len(codes) - n + 1] * np.uint32(0x01000193) + (codes[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
                bits[(gram * np.uint32(0x85EBCA6B) >> np.uint32(8)) % np.uint32(self.dims)] = True
        return found


@dataclass
class KernelModel:
    """Landmark bitmaps (packed), the Nystroem map and the ridge coefficients."""

    languages: list
    landmarks: np.ndarray
    whiten: np.ndarray
    coef: np.ndarray
    settings: Settings

    def kernel(self, bits):
        """Kernel values of bitmaps (rows of float32) against the landmarks."""
        if not hasattr(self, "_marks"):
            marks = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
            self._marks = np.ascontiguousarray((marks / np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))).T)
        return bits @ self._marks / np.sqrt(np.maximum(bits.sum(axis=1, keepdims=True), 1))

    def features(self, bits):
        x = self.kernel(bits) @ self.whiten
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        return np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)

    def predict(self, bits):
        """(index of the best language, its share of the softmax of the scores)."""
        s = self.settings.sharpness * (self.features(bits) @ self.coef)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def solve(packed, labels, languages, settings: Settings) -> KernelModel:
    """Ridge regression on the Nystroem features of the sample; landmarks are dealt evenly over the languages."""
    bits = lambda rows: np.unpackbits(rows, axis=1).astype(np.float32)
    quota = max(1, settings.landmarks // max(1, len(languages)))
    marks = np.concatenate([np.flatnonzero(labels == k)[:quota] for k in range(len(languages))])[: max(settings.landmarks, len(languages))]
    model = KernelModel(languages, packed[marks], np.eye(len(marks), dtype=np.float32), np.zeros((1, 1)), settings)
    values, vectors = np.linalg.eigh(model.kernel(bits(packed[marks])).astype(np.float64))
    keep = values > 1e-6 * values.max()
    model.whiten = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    # the normal equations are summed over blocks, so the sample is never unpacked whole
    gram, right = 0.0, 0.0
    weight = (len(labels) / len(languages)) / np.bincount(labels, minlength=len(languages))[labels]
    for lo in range(0, len(packed), 512):
        x = model.features(bits(packed[lo : lo + 512])).astype(np.float64)
        y = np.where(labels[lo : lo + 512, None] == np.arange(len(languages)), 1.0, -1.0)
        xw = (x * weight[lo : lo + 512, None]).T
        gram, right = gram + xw @ x, right + xw @ y
    gram = gram + settings.ridge * len(packed) * np.eye(len(gram)) / len(gram)
    model.coef = np.linalg.solve(gram, right).astype(np.float32)
    return model


def fit(labelled: DataFrame, settings: Settings = Settings()) -> KernelModel | None:
    """Learn from labelled rows (text, lang): of each language those texts with the smallest hashes, copies once.

    Every language is learnt, however many there are; past fit_rows / per_language of them, each from fewer texts.
    Rows of null lang or without a letter teach nothing. None if there is nothing to learn from.
    """
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    texts = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()  # a row for each language
    if not texts:
        return None
    most = max(1, min(settings.per_language, settings.fit_rows // len(texts)))
    # texts are drawn by their own hash, so the share is of different texts; half as many again make up for the estimate
    limits = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.5 * most / max(r["n"], 1))) for r in texts], "lang string, share double")
    h = F.xxhash64("text")
    drawn = rows.join(F.broadcast(limits), "lang").withColumn("h", h).filter(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        maps = Bitmaps(settings.dims, settings.longest)
        for frame in frames:
            out = []
            for lang, text, h in zip(frame["lang"], frame["text"], frame["h"], strict=True):
                bits = np.zeros(settings.dims, bool)
                if maps.fill(text, bits):
                    out.append((lang, h, np.packbits(bits).tobytes()))
            yield pd.DataFrame(out, columns=["lang", "h", "bits"])

    got: dict[str, dict[int, bytes]] = {}
    for r in drawn.select("lang", "text", "h").mapInPandas(run, "lang string, h bigint, bits binary").dropDuplicates(["lang", "h"]).toLocalIterator():
        got.setdefault(r["lang"], {})[r["h"]] = bytes(r["bits"])
    languages = sorted(got)
    if not languages:
        return None
    sample = [(k, got[lang][h]) for k, lang in enumerate(languages) for h in sorted(got[lang], key=lambda h: (h % (1 << 20), h))[:most]]
    packed = np.stack([np.frombuffer(b, np.uint8) for _, b in sample])
    return solve(packed, np.array([k for k, _ in sample]), languages, settings)


def classify(docs: DataFrame, model: KernelModel | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with the predicted language and its score (0 to 1); a result column replaces one of the same name.

    Null text, or one without a letter: `und` with score 0; so is every text if the model is None. Any
    columns pass through. Repeated rows: one result each. Empty table: empty result.
    """
    taken = {lang_out.lower(), score_out.lower()}
    docs = docs.select([c for c in docs.columns if c.lower() not in taken])
    text_at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    load = by_value(docs.sparkSession, model)
    step = 64

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = load()
        maps = Bitmaps(model.settings.dims, model.settings.longest) if model else None
        for batch in batches:
            texts = batch.column(text_at)
            lang, score = [UND] * len(texts), np.zeros(len(texts))
            for lo in range(0, len(texts) if model else 0, step):
                part = texts[lo : lo + step].to_pylist()
                bits = np.zeros((len(part), maps.dims), bool)
                some = np.flatnonzero([maps.fill(t, b) for t, b in zip(part, bits, strict=True)])
                if len(some):
                    best, p = model.predict(bits[some].astype(np.float32))
                    score[lo + some] = p
                    for i, k in zip(some.tolist(), best.tolist(), strict=True):
                        lang[lo + i] = model.languages[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, lang_out, score_out])

    return docs.mapInArrow(run, schema)


def learning_rows(docs: DataFrame, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """The rows of docs (doc_id, text, lang) that a model may learn from."""
    return docs.filter(id_bucket(F.col("doc_id"), modulus) != held_out).select("text", "lang")


def identify(docs: DataFrame, modulus: int = 4, held_out: int = 2, settings: Settings = Settings()) -> DataFrame:
    """Fit on the rows outside the held-out fold and classify all: doc_id, held_out, lang_pred, score."""
    model = fit(learning_rows(docs, modulus, held_out), settings)
    return classify(docs.select("doc_id", "text"), model).select("doc_id", (id_bucket(F.col("doc_id"), modulus) == held_out).alias("held_out"), "lang_pred", "score")
