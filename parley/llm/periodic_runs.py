"""Runs of periodic repetition in word sequences, by heavy/light lag counting.

A run of period q leaves matches between words q apart. How many matches each lag has is counted exactly: for
words that are rare in their text from the differences of their places, for frequent ones by an FFT
autocorrelation of their indicator. Only lags with as many matches as a run of that period needs are scanned for
islands of matches, and matches that runs already found explain are not counted again at the multiples of their
period. A text is the work of one task; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words that are searched side by side (one text at least), and matches held before they are counted.
GROUP_WORDS, HELD = 1 << 18, 1 << 21
RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def heavy_above(n):
    """Above this many occurrences a word of a text of n words is heavy: there an FFT costs less than all its pairs."""
    return np.maximum(16, (np.sqrt(n * np.log2(np.maximum(n, 2))) / 2).astype(np.int64))


def fft_size(n: int) -> int:
    """The least 2^a or 3 * 2^a that is no less than n."""
    power = 1 << max(n - 1, 1).bit_length()
    return power * 3 // 4 if power * 3 // 4 >= n else power


def lag_counts(word, sizes, most_lags):
    """Exact matches by lag: (counts, base), counts[base[t] + q] for text t and lag q up to most_lags[t].

    word holds small integers of all texts side by side, sizes the words of each text.
    """
    base = np.cumsum(most_lags + 1) - (most_lags + 1)
    counts = np.zeros(int((most_lags + 1).sum()), np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    if not len(word):
        return counts, base
    key = text * (int(word.max()) + 1) + word
    at = np.argsort(key, kind="stable")  # places, by word and then in order
    key = key[at]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(first, len(key)))
    heavy = times > heavy_above(sizes)[text[at[first]]]
    here = np.flatnonzero(np.repeat(~heavy & (times > 1), times))
    end = np.repeat(first + times, times)
    held, n_held, step = [], 0, 1
    while len(here):  # pairs of places that are `step` occurrences of their word apart
        here = here[here + step < end[here]]
        lag, of = at[here + step] - at[here], text[at[here]]
        near = lag <= most_lags[of]
        here, found = here[near], (base[of] + lag)[near]
        held.append(found)
        n_held += len(found)
        if n_held > HELD:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
            held, n_held = [], 0
        step += 1
    if held:
        counts += np.bincount(np.concatenate(held), minlength=len(counts))
    chosen = np.flatnonzero(heavy)
    of = text[at[first[chosen]]]
    for t in np.unique(of):
        lags = int(most_lags[t])
        if lags:
            size = fft_size(int(sizes[t]) + lags)
            begin, mine = int(sizes[:t].sum()), chosen[of == t]
            power = np.zeros(size // 2 + 1)
            for block in np.array_split(mine, -(-len(mine) * size // HELD)):
                marks = np.zeros((len(block), size), np.float64)
                for row, g in enumerate(block):
                    marks[row, at[first[g] : first[g] + times[g]] - begin] = 1.0
                spectrum = np.fft.rfft(marks)
                power += (spectrum.real**2 + spectrum.imag**2).sum(axis=0)
            counts[base[t] : base[t] + lags + 1] += np.rint(np.fft.irfft(power, size)[: lags + 1]).astype(np.int64)
    return counts, base


def runs_of(words, matches, least: int, repeats: int) -> list[tuple[int, int, int]]:
    """Maximal runs (start, length, smallest period) of one text, given its matches by lag (altered here)."""
    lags = np.arange(len(matches))
    need = np.maximum(least - lags, (repeats - 1) * lags)
    need[0] = np.iinfo(np.int64).max
    found, seen = [], set()
    for q in np.flatnonzero(matches >= need).tolist():
        if matches[q] < need[q]:  # runs of a period that divides q have since explained its matches
            continue
        same = np.zeros(len(words) - q + 2, np.int8)
        same[1:-1] = words[q:] == words[:-q]
        edges = np.flatnonzero(same[1:] != same[:-1])
        starts, lengths = edges[::2], edges[1::2] - edges[::2] + q
        long = lengths >= max(least, repeats * q)
        for s, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True):
            if (s, n) in seen:  # a maximal stretch of a smaller period is one of each multiple, too
                continue
            seen.add((s, n))
            found.append((s, n, q))
            multiples = np.arange(2 * q, min(n, len(matches)), q)
            matches[multiples] -= n - multiples  # runs of other periods share none of these matches
    return sorted(found, key=lambda r: (r[0], r[2]))


def _search(text_at: int, least: int, repeats: int, names: tuple[str, str, str]):
    def groups(texts):
        held, size = [], 0
        for t in texts:
            words = (t or "").encode().split()
            held.append(words)
            size += len(words)
            if size >= GROUP_WORDS:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [pa.int64(), to_arrow_type(T.ArrayType(RUN)), pa.string()]
        for batch in batches:
            at = 0
            for texts in groups(batch.column(text_at).to_pylist()):
                number: dict[bytes, int] = {}
                sizes = np.array([len(w) for w in texts], np.int64)
                word = np.fromiter((number.setdefault(x, len(number)) for w in texts for x in w), np.int64, int(sizes.sum()))
                counts, base = lag_counts(word, sizes, sizes // repeats)
                ends, runs, collapsed = np.cumsum(sizes), [], []
                for i, words in enumerate(texts):
                    own = runs_of(word[ends[i] - sizes[i] : ends[i]], counts[base[i] : base[i] + sizes[i] // repeats + 1], least, repeats)
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                    if own:
                        keep = np.ones(len(words), bool)
                        for s, n, q in own:
                            keep[s + q : s + n] = False
                        words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                    collapsed.append(b" ".join(words).decode())
                part = batch.slice(at, len(texts))
                at += len(texts)
                new = [pa.array(v, kind) for v, kind in zip((sizes, runs, collapsed), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *names])

    return run


def find_runs(docs: DataFrame, least: int = 6, repeats: int = 4, text_col: str = "text", names: tuple[str, str, str] = ("n_words", "runs", "collapsed")) -> DataFrame:
    r"""All runs of periodic repetition of every text, and the text without their repeats.

    Words are `[^\x20\x09-\x0D]+`. A run is a stretch of words with smallest period q, words q apart being equal, of
    at least max(least, repeats * q) words, that no neighbouring word extends. Returns all columns of docs plus `names`:
    words; runs as an array of start (from 0), length and period by start, then period; and the words that no run
    contains after its first period, joined by one space. `repeats` is two at least.

    Null and empty texts: no words, no runs, empty result text. Repeated rows have equal results. Empty table: empty
    result. A result replaces a column of its name. Memory is that of an Arrow batch and of a group of GROUP_WORDS words or one text.
    """
    if repeats < 2:
        raise ValueError("a run repeats its period at least twice")
    taken = {c.lower() for c in names}
    docs = docs.select([f"`{c}`" for c in docs.columns if c.lower() not in taken])
    new = [T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(RUN)), T.StructField(names[2], T.StringType())]
    return docs.mapInArrow(_search(docs.columns.index(text_col), least, repeats, names), T.StructType([*docs.schema.fields, *new]))
