"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A bag is one word: its letters between boundary marks, cut into all character n-grams of 3 to 6, hashed to
vectors whose mean is the word's embedding. A misspelling shares most n-grams with the word it spells. The
words of a text are averaged into the text's embedding, each weighted by the exponential of its own toxic log
odds, and a linear softmax over that embedding is the text's score. The weights are a function of the same
parameters, so embeddings and softmax are trained together, from the labels of whole texts alone, and one
insult in 20,000 words still counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import by_value, id_bucket
from parley.llm.quality_classifier import labelled_sample, labelled_texts

U = np.uint64


@dataclass(frozen=True)
class Settings:
    """Bounds and parameters of the fit: of at most `rows` labelled ids, at most `per_class` whole texts of each label."""

    rows: int = 16_000
    per_class: int = 3_000
    buckets: int = 1 << 17
    size: int = 12
    shortest: int = 3
    longest: int = 6
    epochs: int = 10
    batch: int = 64
    rate: float = 0.3
    emphasis: float = 2.5  # what a toxic text's loss counts against a clean one's


class Bags:
    """Words of texts as bags of hashed n-grams, for whole buffers at once."""

    def __init__(self, settings: Settings, piece: int = 1 << 18):
        self.s, self.piece = settings, piece
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.powers = np.ones(1, U)

    def codes(self, text: str):
        """Lower-cased letters, with every run of anything else as one boundary, and a boundary at each end."""
        c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        letters = self.letter[c]
        keep = letters.copy()
        keep[1:] |= letters[:-1]
        return np.concatenate(([32], np.where(letters, c, 32)[keep], [32])).astype(np.uint32)

    def words(self, codes):
        """(start of the left boundary, length with both boundaries) of every word."""
        edge = np.flatnonzero(codes == 32)
        length = np.diff(edge) + 1
        real = length > 2
        return edge[:-1][real], length[real]

    def keys(self, codes, start, length):
        """A 64-bit hash of each word's letters."""
        if len(self.powers) < (most := int(length.max(initial=1))):
            steps = np.full(2 * most, 0x9E3779B97F4A7C15, U)
            steps[0] = 1
            self.powers = np.multiply.accumulate(steps)
        at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        x = (codes[at].astype(U) + U(1)) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(29))) * self.powers[at - np.repeat(start, length)]
        total = np.concatenate((np.zeros(1, U), np.cumsum(x)))
        end = np.cumsum(length)
        return total[end] - total[end - length]

    def hashed(self, codes):
        """For each n the bucket of the n-gram that starts at each place."""
        gram = np.zeros(len(codes), np.uint32)
        for n in range(1, self.s.longest + 1):
            if len(codes) < n:
                return
            gram = (gram[: len(codes) - n + 1] ^ (codes[n - 1 :] * np.uint32(0x9E3779B1))) * np.uint32(0x01000193)
            gram = gram ^ (gram >> np.uint32(15))
            if n >= self.s.shortest:
                yield n, (gram * np.uint32(0x85EBCA6B) >> np.uint32(4)) % np.uint32(self.s.buckets)

    def lists(self, codes, start, length):
        """Buckets of the n-grams of each given word, side by side, and their number for each word."""
        count, parts = np.zeros(len(start), np.int64), []
        for n, bucket in self.hashed(codes):
            k = np.maximum(length - n + 1, 0)
            owner = np.repeat(np.arange(len(start)), k)
            parts.append((owner, bucket[start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(k) - k, k)]))
            count += k
        if not parts:
            return np.zeros(0, np.int32), count
        owner = np.concatenate([p[0] for p in parts])
        return np.concatenate([p[1] for p in parts])[np.argsort(owner, kind="stable")].astype(np.int32), count

    def means(self, codes, values):
        """The mean of `values` (one for each bucket) over each word's bag."""
        start, length = self.words(codes)
        total, count = np.zeros(len(start)), np.zeros(len(start))
        for n, bucket in self.hashed(codes):
            sums = np.concatenate(([0.0], np.cumsum(values[bucket], dtype=np.float64)))
            k = np.maximum(length - n + 1, 0)
            total += np.where(k > 0, sums[np.minimum(start + k, len(sums) - 1)] - sums[np.minimum(start, len(sums) - 1)], 0)
            count += k
        return total / np.maximum(count, 1)


@dataclass
class ToxicityModel:
    """The softmax's log odds of each n-gram vector and its bias, and the log odds of a text without words."""

    values: np.ndarray
    bias: float
    empty: float
    settings: Settings

    def log_odds(self, bags: Bags, text: str | None) -> float:
        """The softmax's log odds of a text's averaged embedding, which is the average of its words' log odds."""
        weight = total = top = 0.0
        for part in pieces(text or "", bags.piece):
            odds = bags.means(bags.codes(part), self.values) + self.bias
            if not len(odds):
                continue
            high = float(max(top, odds.max()))
            w = np.exp(odds - high)
            weight, total = weight * np.exp(top - high) + float(w.sum()), total * np.exp(top - high) + float(w @ odds)
            top = high
        return total / weight if weight else self.empty

    def score(self, log_odds):
        return 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))


def pieces(text: str, size: int) -> Iterator[str]:
    """A text in pieces of about `size`, cut at blanks; a longer word stays whole."""
    lo = 0
    while lo < len(text):
        hi = lo + size
        if hi < len(text):
            cut = text.rfind(" ", lo + 1, hi)
            if cut < 0:
                cut = text.find(" ", hi)
            hi = cut if cut > 0 else len(text)
        yield text[lo:hi]
        lo = hi


@dataclass
class Corpus:
    """Texts as numbers of distinct words with their counts, side by side, and each word's n-gram buckets, side by side."""

    word: np.ndarray
    times: np.ndarray
    size: np.ndarray
    bucket: np.ndarray
    grams: np.ndarray


def read_texts(texts: list[str | None], s: Settings) -> Iterator[tuple]:
    """Of each whole text (keys of its distinct words, their counts, the words new here, each with a blank before and after, in UTF-8)."""
    bags, seen = Bags(s), set()
    for text in texts:
        keys, fresh = [np.zeros(0, U)], []
        for part in pieces(text or "", bags.piece):
            codes = bags.codes(part)
            start, length = bags.words(codes)
            found = bags.keys(codes, start, length)
            keys.append(found)
            names, at = np.unique(found, return_index=True)
            new = at[[k not in seen for k in names.tolist()]] if len(at) else at
            seen.update(found[new].tolist())
            fresh.append(codes[_ranges(start[new], length[new])].astype("<u4").tobytes().decode("utf-32-le"))
        words, times = np.unique(np.concatenate(keys), return_counts=True)
        yield words, times.astype(np.int32), "".join(fresh).encode()


def assemble(rows: list[tuple], s: Settings, block: int = 1 << 19) -> Corpus:
    """Rows of read_texts, from one reader or several, as one corpus; words met by several readers count once."""
    bags, names = Bags(s), np.zeros(0, U)
    key, bucket, grams = [], [np.zeros(0, np.int32)], []
    for part in pieces(b" ".join(r[2] for r in rows).decode(), block):
        codes = bags.codes(part)
        start, length = bags.words(codes)
        fresh, at = np.unique(bags.keys(codes, start, length), return_index=True)
        at = at[~np.isin(fresh, names)]
        names = np.union1d(names, fresh)
        found, count = bags.lists(codes, start[at], length[at])
        key.append(bags.keys(codes, start[at], length[at]))
        bucket.append(found)
        grams.append(count)
    order = np.argsort(np.concatenate([np.zeros(0, U), *key]))
    grams, bucket = np.concatenate([np.zeros(0, np.int64), *grams]), np.concatenate(bucket)
    bucket = bucket[_ranges((np.cumsum(grams) - grams)[order], grams[order])]
    word = np.searchsorted(names, np.concatenate([np.zeros(0, U), *[r[0] for r in rows]])).astype(np.int32)
    times = np.concatenate([np.zeros(0, np.int32), *[r[1] for r in rows]])
    return Corpus(word, times, np.array([len(r[0]) for r in rows], np.int64), bucket, grams[order])


def _ranges(begin, size):
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def train(corpus: Corpus, labels, s: Settings = Settings(), seed: int = 7) -> ToxicityModel:
    """Fit embeddings and softmax to labelled texts (0 or 1) by AdaGrad on the text loss. Without both labels: the (smoothed) prior."""
    y = np.asarray(labels, float)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    empty = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(s.buckets, np.float32), empty, empty, s)
    rng = np.random.default_rng(seed)
    E, W, b = (rng.random((s.buckets, s.size)) - 0.5) / s.size, rng.random((s.size, 2)) - 0.5, np.array([0.0, empty])
    gE, gW, gb = np.full(s.buckets, 1e-6), np.full(s.size, 1e-4), 1e-4
    first, gram_at = np.cumsum(corpus.size) - corpus.size, np.cumsum(corpus.grams) - corpus.grams
    ok = np.flatnonzero(corpus.size > 0)
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs) + 0.02
        order = rng.permutation(ok)
        for lo in range(0, len(order), s.batch):
            texts = order[lo : lo + s.batch]
            size = corpus.size[texts]
            at = _ranges(first[texts], size)
            begin = np.cumsum(size) - size
            words, slot = np.unique(corpus.word[at], return_inverse=True)
            n = corpus.grams[words]
            grams = corpus.bucket[_ranges(gram_at[words], n)]
            # a word's log odds are those of the mean of its vectors, hence the mean of its vectors' own ones
            apart = W[:, 1] - W[:, 0]
            odds = np.add.reduceat((E @ apart)[grams], np.cumsum(n) - n) / n + b[1] - b[0]
            o = odds[slot]
            top = np.maximum.reduceat(o, begin)
            a = corpus.times[at] * np.exp(o - np.repeat(top, size))
            a /= np.repeat(np.add.reduceat(a, begin), size)
            z = np.add.reduceat(a * o, begin)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[texts]) * np.where(y[texts] > 0, s.emphasis, 1.0)
            # a text's log odds move with a word's own ones and, through its weight, with how far it stands out
            back = np.bincount(slot, a * (1 + o - np.repeat(z, size)) * np.repeat(d, size), len(words)) / len(texts)
            share = np.bincount(grams, np.repeat(back / n, n), s.buckets)
            touched = np.flatnonzero(share)
            dW, db = E[touched].T @ share[touched], back.sum()
            gE[touched] += share[touched] ** 2 * (apart**2).mean()
            E[touched] -= np.outer(rate * share[touched] / np.sqrt(gE[touched]), apart)
            gW += dW**2
            W += np.outer(0.2 * rate * dW / np.sqrt(gW), [1.0, -1.0])
            gb += db**2
            b += 0.2 * rate * db / np.sqrt(gb) * np.array([1.0, -1.0])
    return ToxicityModel((E @ (W[:, 1] - W[:, 0])).astype(np.float32), float(b[1] - b[0]), empty, s)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", s: Settings = Settings()) -> ToxicityModel:
    """Learn from labelled documents; docs and labels hold only what may be learnt from.

    Executors read the sampled texts whole and send hashes of their distinct words with counts, and each word once
    a task; the driver cuts the distinct words into n-grams, a block of them at a time.
    """
    sample = labelled_sample(labels, label, s.rows)
    some = sample.filter("y = 1").limit(s.per_class).unionAll(sample.filter("y = 0").limit(s.per_class))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = list(read_texts(batch.column(0).to_pylist(), s))
            columns = [pa.array([bytes(r[i]) for r in rows], pa.binary()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), batch.column(2), *columns], ["y", "h", "words", "times", "fresh"])

    schema = "y int, h bigint, words binary, times binary, fresh binary"
    got = labelled_texts(docs, some).mapInArrow(run, schema)  # a row for each sampled id
    got = got.toArrow().sort_by([("h", "ascending"), ("y", "ascending")])  # the order of rows does not show
    words, times, fresh = (got.column(c).to_pylist() for c in ("words", "times", "fresh"))
    rows = [(np.frombuffer(w, U), np.frombuffer(n, np.int32), f) for w, n, f in zip(words, times, fresh, strict=True)]
    return train(assemble(rows, s), got.column("y").to_numpy(), s)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the chance that a text is toxic; a result column replaces one of the same name. Null and empty texts have no bag."""
    docs = docs.select([c for c in docs.columns if c.lower() != out.lower()])
    text_at = docs.columns.index(text_col)
    load = by_value(docs.sparkSession, model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = load()
        bags = Bags(model.settings)
        for batch in batches:
            odds = np.zeros(batch.num_rows)
            for lo in range(0, batch.num_rows, 512):
                part = batch.column(text_at).slice(lo, 512).to_pylist()
                odds[lo : lo + len(part)] = [model.log_odds(bags, t) for t in part]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(odds), pa.float64())], [*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def classify_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, cut: float = 0.7) -> DataFrame:
    """Fit outside the held-out fold and score every row: doc_id, held_out, score, predicted.

    Labels are learnt only from rows whose crc32(doc_id as text) modulo `modulus` is not `held_out`. Null
    labels and ids teach nothing; with no label at all, or one kind, every score is the (smoothed) prior.
    Null or empty text: scored as a text without words. Repeated rows: one result each. Empty documents:
    empty result. Other columns are not read.
    """
    fold = lambda df: df.filter(id_bucket(F.col("doc_id"), modulus) != held_out)
    model = fit(fold(docs), fold(labels.select("doc_id", "toxic")))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (id_bucket(F.col("doc_id"), modulus) == held_out).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
