"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import fresh
from parley.llm.components import connected_components
from parley.session import materialise

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BITS = 64


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The SimHash of one text; 0 for a text without words."""
    import xxhash

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1]))
    stops = ends[min(shingle, len(words)) - 1 :][:n] - 1
    ones, block = np.zeros(BITS, np.int64), 1 << 13
    for lo in range(0, n, block):
        hashes = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[lo : lo + block].tolist(), stops[lo : lo + block].tolist())])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def text_digest(text: Column) -> Column:
    """Tells apart the texts of one doc_id; a null text has the empty digest."""
    return F.coalesce(F.md5(text.cast("string")), F.lit(""))


def fingerprints(docs: DataFrame, shingle: int = 4, digest: bool = False) -> DataFrame:
    """(doc_id, fp) of every row, with its text_digest if asked for; fp holds the fingerprint's 64 bits as a signed long."""
    keys = ["doc_id", "digest"] if digest else ["doc_id"]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            fps = np.array([fingerprint(t, shingle) for t in frame["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({**{k: frame[k] for k in keys}, "fp": fps})

    rows = docs.select("doc_id", *([text_digest(F.col("text")).alias("digest")] if digest else []), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {'digest string, ' if digest else ''}fp bigint")


def block_masks(distance: int, rows: int) -> list[int]:
    """Masks such that fingerprints within `distance` bits agree under at least one of them.

    distance + r blocks leave r that agree; r grows with the number of fingerprints so that a mask's r blocks
    spell about rows values, which keeps the pairs that agree by chance in proportion to the rows. Any r finds
    the same pairs.
    """
    r = 1
    while r < 6 and r * BITS // (distance + r) < np.log2(max(rows, 2)) + 1:
        r += 1
    return masks_over(list(range(BITS)), distance, r)


def masks_over(places: list[int], distance: int, r: int) -> list[int]:
    """All unions of r of distance + r blocks of the given bit places."""
    edges = np.linspace(0, len(places), distance + r + 1).astype(int)
    blocks = [sum(1 << p for p in places[a:b]) for a, b in zip(edges, edges[1:])]
    assert len(blocks) == distance + r and comb(distance + r, r) == len(list(combinations(blocks, r)))
    return [sum(c) for c in combinations(blocks, r)]


def _forest(fps, distance: int):
    """Edges that connect whatever is connected within `distance` bits among distinct fingerprints.

    A search from one fingerprint to the next: those already reached are compared no more, so a dense group
    costs its size, not its square, and yields one edge per member.
    """
    left, edges = fps, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        root = queue[0]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= distance
            if near.any():
                reached = left[near]
                edges.append(np.column_stack([np.full(len(reached), root), reached]))
                queue.extend(reached)
                left = left[~near]
    return edges


def _within(fps, distance: int, large: int = 2048, depth: int = 0):
    """Edges that connect whatever is connected within `distance` bits; a large group is blocked again on the bits in which it differs.

    So a group that agrees under a mask by chance costs its size times a few sorts. What stays together under the inner
    masks as well is dense, which _forest is made for, or as few as the bits that are left can spell.
    """
    if len(fps) <= large or depth == 2:
        return _forest(fps, distance)
    differ = int(np.bitwise_or.reduce(fps ^ fps[0]))
    places = [b for b in range(BITS) if differ >> b & 1]
    r = 1
    while r < 6 and r * len(places) // (distance + r) < np.log2(len(fps)) + 1:
        r += 1
    edges = []
    for mask in masks_over(places, distance, r):
        part = fps & np.uint64(mask)
        order = np.argsort(part, kind="stable")
        first = np.flatnonzero(np.diff(part[order], prepend=~part[order[:1]]))
        sizes = np.diff(np.append(first, len(fps)))
        for k in np.flatnonzero(sizes > 1):
            edges.extend(_within(fps[order[first[k] : first[k] + sizes[k]]], distance, large, depth + 1))
    return edges


def _links(distance: int, small: int = 24):
    """Rows (mask, part, fp) sorted by mask and part to edges (a, b)."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        def edges_of(mask, part, fp):
            change = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
            first = np.concatenate(([0], change))
            sizes = np.diff(np.concatenate((first, [len(fp)])))
            found = []
            group = np.repeat(np.where(sizes <= small, np.arange(len(sizes)), -1 - np.arange(len(sizes))), sizes)
            for d in range(1, int(sizes[sizes <= small].max(initial=1))):  # small groups side by side
                same = (group[d:] == group[:-d]) & (group[d:] >= 0)
                i = np.flatnonzero(same)
                i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= distance]
                found.append(np.column_stack([fp[i], fp[i + d]]))
            for k in np.flatnonzero(sizes > small):
                found.extend(_within(fp[first[k] : first[k] + sizes[k]], distance))
            return np.concatenate(found).view(np.int64) if found else np.zeros((0, 2), np.int64)

        held = None
        for frame in frames:
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            if not len(frame):
                continue
            mask, part = frame["mask"].to_numpy(), frame["part"].to_numpy()
            cut = int(np.flatnonzero((mask != mask[-1]) | (part != part[-1])).max(initial=-1)) + 1  # the last group may go on
            held = frame.iloc[cut:]
            if cut:
                e = edges_of(mask[:cut], part[:cut], frame["fp"].to_numpy()[:cut].view(np.uint64))
                yield pd.DataFrame({"a": e[:, 0], "b": e[:, 1]})
        if held is not None and len(held):
            e = edges_of(held["mask"].to_numpy(), held["part"].to_numpy(), held["fp"].to_numpy().view(np.uint64))
            yield pd.DataFrame({"a": e[:, 0], "b": e[:, 1]})

    return run


def near_links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """Distinct fingerprints (fp) to edges (a, b) that join all and only what links within `distance` bits join."""
    masks = block_masks(distance, distinct.count())
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(signed)])).alias("k")
    blocked = distinct.select(keys, "fp").select("k.*", "fp")
    dealt = blocked.repartition("mask", "part").sortWithinPartitions("mask", "part")
    return dealt.mapInPandas(_links(distance), "a bigint, b bigint")


def fingerprint_classes(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Every fingerprint of prints (doc_id, fp) once: fp, class (the least fingerprint in it), component_id (its smallest doc_id)."""
    per = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    classes = connected_components(near_links(per.select("fp"), distance))
    classed = per.join(classes, per.fp == classes.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    least = classed.groupBy("class").agg(F.min("least").alias("component_id"))
    return materialise(classed.join(least, "class").select("fp", "class", "component_id"), "simhash-classes")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    r"""The near-duplicate class of every row of docs (doc_id, text).

    Texts have A-Z lower-cased, words `[^\x20\x09-\x0D]+` and shingles of `shingle` words, repeats included (a
    shorter text is one shingle). Fingerprints at `distance` bits or fewer are linked; copies share one
    fingerprint and count once. Returns doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id
    in the class).

    Null or blank text: fingerprint 0, linked like any other. Null doc_id: ignored as a component_id unless
    the class has no other. Repeated rows: one result each. Empty table: empty result. Other columns are not
    read. One group of fingerprints that agree under a mask is searched in one task, at 16 bytes for each
    distinct fingerprint; a large one is blocked again there, so that it does not cost its square.
    """
    prints = materialise(fingerprints(docs, shingle), "simhash-fingerprints")
    named = fingerprint_classes(prints, distance)
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """docs with one row of each near-duplicate class: the first by doc_id (nulls last), then text.

    Keeps all columns, of whatever names. Classes are those of the fingerprints, so rows of one doc_id, or of none,
    in different classes do not displace each other. Null and blank texts are one class. Repeated rows: one stays.
    Empty table: empty result.
    """
    prints = materialise(fingerprints(docs, shingle, digest=True), "simhash-fingerprints")
    first = prints.join(fingerprint_classes(prints, distance), "fp").filter("doc_id <=> component_id")
    class_, n = fresh(docs, "class"), fresh(docs, "rank")
    first = first.select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"), F.col("class").alias("kept_class")).distinct()
    same = docs["doc_id"].eqNullSafe(first["kept_id"]) & (text_digest(docs["text"]) == first["kept_digest"])
    kept = docs.join(first, same).select(*[docs[c] for c in docs.columns], first["kept_class"].alias(class_))
    return kept.withColumn(n, F.row_number().over(Window.partitionBy(class_).orderBy("text"))).filter(F.col(n) == 1).drop(class_, n)
