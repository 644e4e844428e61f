"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k.

Every segmentation of a text has a log probability; adding Gumbel noise and taking the k largest draws k
distinct ones without replacement. The largest is found without listing any: a perturbed A* search keeps for
each untried branch of the lattice the maximum over all segmentations behind it, which is one truncated
Gumbel variable whose location is the branch's exact log probability, and follows the highest. The value
that would come next is the threshold kappa, and gives each sample's chance of inclusion.

All texts of a batch are searched side by side; the noise hangs on the row key, not on the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import by_value
from parley.llm.piece_lattice import Pieces, Solved, U, Units, mix, uniform

BATCH_CHARS = 1 << 18


def salt(purpose: int):
    """What sets apart the noise of one purpose."""
    return mix(np.array([purpose], U))[0]


def _truncated(location, limit, u):
    """Gumbel variables of a location, given that they do not exceed the limit."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return np.where(np.isfinite(location), location - np.log(np.exp(np.minimum(location - limit, 700)) - np.log(u)), -np.inf)


class Paths:
    """One segmentation for each of some texts: steps in the order in which they were decided."""

    def __init__(self, text, unit, step, edge, n_texts, prob):
        order = np.argsort((unit << 20) | step, kind="stable")  # runs in order already, which a merge sort only joins
        self.text, self.unit, self.step, self.edge = text[order], unit[order], step[order], edge[order]
        self.first = np.searchsorted(self.text, np.arange(n_texts + 1))
        q = np.log(np.maximum(prob[self.edge], 1e-300))
        total = np.concatenate(([0.0], np.cumsum(q)))
        self.before = total[:-1] - total[self.first[:-1]][self.text]
        some = np.flatnonzero(np.diff(self.first) > 0)  # each text summed by itself, so the batch does not show in the last digits
        self.log_p = np.zeros(n_texts)
        self.log_p[some] = np.add.reduceat(q, self.first[:-1][some]) if len(some) else 0.0


class Samples:
    """The samples of some texts: sample j of text i has the ids from first[r] to first[r + 1], r = row[i, j]; -1 where there is none."""

    def __init__(self, n: int, k: int):
        self.row = np.full((n, k), -1, np.int64)
        self.ids, self.first, self.log_prob, self.log_inclusion = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0), np.zeros(0)

    def add(self, j: int, texts, ids, ends, log_prob, log_inclusion) -> None:
        """Sample j of the given texts: their ids side by side, where each one's end, and their scores."""
        self.row[texts, j] = len(self.log_prob) + np.arange(len(texts))
        self.first = np.concatenate([self.first, len(self.ids) + ends])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.log_prob, self.log_inclusion = np.concatenate([self.log_prob, log_prob]), np.concatenate([self.log_inclusion, log_inclusion])


def sample_texts(vocab: Pieces, texts: list[str], keys, k: int, solved: Solved | None = None) -> list[list[tuple]]:
    """For each text up to k samples (ids, log probability, log of the inclusion probability), highest noise first."""
    s = draw_samples(solved or Solved(vocab), texts, keys, k)
    return [[(s.ids[s.first[r] : s.first[r + 1]], float(s.log_prob[r]), float(s.log_inclusion[r])) for r in rows if r >= 0] for rows in s.row.tolist()]


def draw_samples(solved: Solved, texts: list[str], keys, k: int) -> Samples:
    """Up to k samples of each text; a text without characters has one, without ids."""
    n = len(texts)
    lattice = Units(solved, texts)
    samples = Samples(n, k)
    if not len(lattice.text_of):
        samples.add(0, np.arange(n), np.zeros(0, np.int32), np.zeros(n, np.int64), np.zeros(n), np.zeros(n))
        return samples
    owner = lattice.text_of
    first_unit = np.searchsorted(owner, np.arange(n))
    seeds = mix(np.asarray(keys, np.int64).view(U))
    ordinal = ((np.arange(len(owner)) - first_unit[owner]) << 20).astype(U)
    unit_seeds, prob = seeds[owner], lattice.prob

    def path(units, round_):
        """Fresh draws for whole units."""
        who, step, edge = lattice.draw(units, lattice.tops(units), unit_seeds[units] ^ salt(round_), ordinal[units])
        return units[who], step, edge

    def branches(p, limit, round_, after=None):
        """The best of what each step of a path passed over; steps up to `after` belong to another path."""
        value, chance = np.full(len(p.edge), -np.inf), prob[p.edge]
        fork = np.flatnonzero(chance < 1 if after is None else (chance < 1) & (np.arange(len(p.edge)) > after[p.text]))
        text = p.text[fork]
        u = uniform(seeds[text] ^ salt(1000 + round_), (fork - p.first[text]).astype(U))
        value[fork] = _truncated(p.before[fork] + np.log(1 - chance[fork]), limit[text], u)
        return value

    def best(p, value):
        """(highest value, its step) for each text."""
        top, where = np.full(n, -np.inf), np.full(n, -1)
        some = np.flatnonzero(np.diff(p.first) > 0)
        if len(some):
            top[some] = np.maximum.reduceat(value, p.first[:-1][some])
            hit = np.flatnonzero(value == top[p.text])[::-1]
            where[p.text[hit]] = hit
        return top, where

    zero = np.zeros(n, U)
    noise = -np.log(-np.log(uniform(seeds, zero)))
    unit, step, edge = path(np.arange(len(owner)), 0)
    p = Paths(owner[unit], unit, step, edge, n, prob)
    emitted = [(p, noise, np.ones(n, bool))]
    pool = [(p, branches(p, noise, 0), None)]  # what is untried: by step of a path, or one residue for each text
    kappa = None
    for round_ in range(1, k + 1):
        tops = [best(q, v) if gone is None else (v, gone[0]) for q, v, gone in pool]
        values = np.stack([t[0] for t in tops])
        pick = values.argmax(axis=0)
        top = values[pick, np.arange(n)]
        if round_ == k:
            kappa = top
            break
        live = np.isfinite(top)
        # where each text leaves which path, and the edges there that have been tried
        left, tried = np.full(n, -1), np.full((n, k + 1), -1)
        text, unit, step, edge = [], [], [], []
        kept_unit, kept_step, at_node, spent = np.full(n, -1), np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
        prefix = np.zeros(n)
        for i, (q, v, gone) in enumerate(pool):
            mine = np.flatnonzero(live & (pick == i))
            if not len(mine):
                continue
            s = tops[i][1][mine]
            left[mine] = s
            if gone is None:
                tried[mine, 0] = q.edge[s]
                v[s] = -np.inf
            else:
                tried[mine] = gone[1][mine]
                v[mine] = -np.inf
            kept_unit[mine], kept_step[mine], prefix[mine] = q.unit[s], q.step[s], q.before[s]
            at_node[mine] = lattice.target[q.edge[s]] - 1
            before_fork = np.zeros(n, np.int64)
            before_fork[mine] = s
            held = np.flatnonzero(np.arange(len(q.text)) < before_fork[q.text])
            for out, x in zip((text, unit, step, edge), (q.text, q.unit, q.step, q.edge), strict=True):
                out.append(x[held])
        for c in range(k + 1):
            spent += np.where(tried[:, c] >= 0, prob[np.maximum(tried[:, c], 0)], 0)
        who = np.flatnonzero(live)
        # another edge out of the node where the path is left, in proportion to its chance
        r = uniform(seeds[who], np.full(len(who), 77_000 + round_, U)) * np.maximum(1 - spent[who], 0)
        other, cursor, open_ = np.full(len(who), -1), lattice.first[at_node[who]].astype(np.int64), np.ones(len(who), bool)
        stop = lattice.stop[at_node[who]]
        while open_.any():
            here = np.minimum(cursor, stop - 1)
            free = open_ & (cursor < stop) & ~(tried[who] == here[:, None]).any(axis=1)
            other[free] = here[free]
            r[free] -= prob[here[free]]
            open_ &= (cursor < stop) & (r >= 0)
            cursor = cursor + 1
        begun = lattice.source[other] - 1
        start = np.where(lattice.source[other] > lattice.begin[at_node[who]], begun, -1)
        w, s2, e2 = lattice.draw(kept_unit[who], start, seeds[who] ^ salt(50_000 + round_), ordinal[kept_unit[who]])
        later = np.flatnonzero(live[owner] & (np.arange(len(owner)) > kept_unit[owner]))
        u3, s3, e3 = path(later, round_)
        text += [who, who[w], owner[u3]]
        unit += [kept_unit[who], kept_unit[who][w], u3]
        step += [kept_step[who], kept_step[who][w] + 1 + s2, s3]
        edge += [other, e2, e3]
        text, unit, step, edge = (np.concatenate(x).astype(np.int64) for x in (text, unit, step, edge))
        p = Paths(text, unit, step, edge, n, prob)
        emitted.append((p, top, live))
        place = np.full(n, -1)
        at = np.flatnonzero((p.unit == kept_unit[p.text]) & (p.step == kept_step[p.text]))
        place[p.text[at]] = at
        pool.append((p, branches(p, top, round_, place), None))
        tried[who, np.argmax(tried[who] < 0, axis=1)] = other
        rest = np.maximum(1 - spent[who] - prob[other], 0)
        location = np.full(n, -np.inf)
        enough = (rest > 1e-12) & ((tried[who] >= 0).sum(axis=1) < stop - lattice.first[at_node[who]])
        location[who[enough]] = prefix[who[enough]] + np.log(rest[enough])
        pool.append((p, _truncated(location, top, uniform(seeds, np.full(n, 99_000 + round_, U))), (place, tried.copy())))
    for j, (p, _, live) in enumerate(emitted):
        # text order: units as they come, steps of a unit from left to right
        begin = np.flatnonzero(np.diff(p.unit, prepend=-1))
        stop = np.append(begin[1:], len(p.unit))
        ids, count = lattice.spell(p.edge[np.repeat(begin + stop - 1, stop - begin) - np.arange(len(p.unit))])
        ends = np.concatenate(([0], np.cumsum(count)))[p.first]
        x = p.log_p - kappa
        with np.errstate(over="ignore", divide="ignore"):
            log_in = np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 30)))))
        who = np.flatnonzero(live)
        samples.add(j, who, ids, ends[who + 1], np.round(p.log_p[who], 9), np.round(log_in[who], 9))  # what is not live has no ids
    return samples


RESULT = "sample int, n_pieces bigint, ids array<int>, ids_sha256 string, log_prob double, log_inclusion double, decoded boolean"


def sample_segmentations(docs: DataFrame, model_path: str, k: int = 2, key_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, alpha: float = 1.0) -> DataFrame:
    """Up to k distinct sampled segmentations of every text, drawn without replacement.

    Returns the key column, sample (0 is the one with most noise), n_pieces, ids (null unless with_ids),
    ids_sha256 (of the ids as little-endian 32-bit integers), log_prob, log_inclusion (of the chance that
    the sample is among the k, given the threshold) and decoded: whether the ids spell exactly the text.
    The vocabulary is read on the driver from model_path and sent to the executors.

    Null text: one row, n_pieces 0 and ids empty, as an empty text. A text with fewer than k segmentations
    has as many rows. Null key: drawn as key 0. Repeated rows draw alike. Texts of any length are whole: a
    batch holds at least one. Empty table: empty result. Other columns are not read.
    """
    kind = docs.schema[key_col].dataType
    key = F.coalesce(F.xxhash64(F.col(f"`{key_col}`").cast("string")), F.lit(0))
    rows = docs.select(F.col(f"`{key_col}`").alias("k"), key.alias("seed"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    load = by_value(docs.sparkSession, Pieces.load(model_path, alpha))
    schema = T.StructType([T.StructField(key_col, kind), *T._parse_datatype_string(RESULT).fields])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        vocab = load()
        solved = Solved(vocab)

        def solve(keys, seeds, texts, key_type):
            s = draw_samples(solved, texts, np.array(seeds, np.int64), k)
            text, sample = np.nonzero(s.row >= 0)
            r = s.row[text, sample]
            size = np.diff(s.first)[r]
            ids = s.ids[np.repeat(s.first[r] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            stop = np.concatenate(([0], np.cumsum(size)))
            spelled, at = vocab.decode_many(ids, stop)
            spelled, raw = spelled.tobytes(), ids.astype("<i4").tobytes()
            utf8 = [b" " + t.encode() if t else b"" for t in texts]
            decoded = [spelled[a:b] == utf8[i] for i, a, b in zip(text.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
            digests = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.array(ids, pa.int32())) if with_ids else pa.nulls(len(r), pa.list_(pa.int32()))
            columns = [
                pa.array([keys[i] for i in text.tolist()], key_type), pa.array(sample, pa.int32()), pa.array(size, pa.int64()), lists,
                pa.array(digests, pa.string()), pa.array(s.log_prob[r]), pa.array(s.log_inclusion[r]), pa.array(decoded, pa.bool_()),
            ]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            held, size = ([], [], []), 0
            key_type = batch.schema.field("k").type
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for row in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if held[0] and size + len(row[2]) > BATCH_CHARS:
                        yield solve(*held, key_type)
                        held, size = ([], [], []), 0
                    for column, x in zip(held, row, strict=True):
                        column.append(x)
                    size += len(row[2])
            if held[0]:
                yield solve(*held, key_type)

    return rows.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, model_path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """rows with the text that a column of ids spells; null ids give null. A result column replaces one of the same name."""
    rows = rows.select([c for c in rows.columns if c.lower() != out.lower()])
    load = by_value(rows.sparkSession, Pieces.load(model_path))
    at = rows.columns.index(ids_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        vocab = load()
        for batch in batches:
            texts = [None if ids is None else vocab.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))
