"""Voice vectors: ranking with rejection, centroids, separation, single-speaker and partition tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import scalar as S
from parley.helpers import broadcast_bounded
from parley.session import materialise

MATCH, GAP = 0.72, 0.03


def centroids(rows: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """The unit mean of each group's non-zero vectors, and how many there are; summed per dimension, never gathered."""
    d = rows.filter(S.norm(F.col(vector)) > 1e-6).select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
    mean = d.groupBy(*keys, "dim").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"])
    return mean.groupBy(*keys).agg(vec.alias("v"), F.first("n").alias("samples")).select(*keys, S.unit(F.col("v")).alias("centroid"), "samples")


def rank_profiles(queries: DataFrame, profiles: DataFrame, key: str = "vec_id", bound: int = 5_000) -> DataFrame:
    """Every query's similarity to every enrolled profile (name, centroid), best first.

    Profiles are the people enrolled, a stated set: up to `bound` of them are broadcast whole, more of them
    in blocks of that size.
    """
    return broadcast_bounded(queries, profiles, "name", bound, lambda q, p: q.crossJoin(p)).select(key, "name", F.round(S.cosine(F.col("embedding"), F.col("centroid")), 6).alias("score"))


def match_voice(ranked: DataFrame, key: str = "vec_id", least: float = MATCH, gap: float = GAP) -> DataFrame:
    """The best profile unless it is too far or the runner-up is as good; Unknown then. No query's scores are gathered."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "name")
    top2 = ranked.withColumn("r", F.row_number().over(w)).filter("r <= 2").groupBy(key).agg(
        F.max(F.when(F.col("r") == 1, F.col("name"))).alias("name"), F.max("score").alias("best"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))), F.lit(-1.0)).alias("second")
    )
    close = (F.col("second") >= least) & (F.col("best") - F.col("second") < gap)
    name = F.when((F.col("best") < least) | close, "Unknown").otherwise(F.col("name"))
    return top2.select(key, name.alias("name"), F.round("best", 3).alias("score"))


def match_profiles(queries: DataFrame, profiles: DataFrame, key: str = "vec_id", least: float = MATCH, gap: float = GAP, block: int = 4_096) -> DataFrame:
    """What match_voice gives over rank_profiles (key, name, score), without a row for any pair of query and profile.

    Profiles go out in blocks of `block` rows. A batch of queries meets a block in one matrix product, of which each query keeps
    its best two; where there are several blocks, the two of each are merged. A query or profile of length zero is like none.
    """
    n = profiles.count()
    parts = -(-n // block)
    if parts > 1:
        profiles = materialise(profiles.select("name", "centroid").withColumn("block", F.pmod(F.xxhash64("name", "centroid"), F.lit(parts))), "profile-blocks")
    kind = queries.schema[key].dataType.simpleString()
    two = f"{key} {kind}, name string, best double, second_name string, second double"
    d = queries.select(key, F.col("embedding").cast("array<double>").alias("embedding"))
    found = None
    for b in range(max(parts, 1)):
        rows = (profiles.filter(F.col("block") == b) if parts > 1 else profiles).select("name", F.col("centroid").cast("array<double>").alias("c")).orderBy("name").collect()  # about `block` rows
        held = queries.sparkSession.sparkContext.broadcast(([r["name"] for r in rows], [list(r["c"]) for r in rows]))
        each = d.mapInArrow(_best_two(held), two)
        found = each if found is None else found.unionAll(each)
    if parts > 1:
        pair = lambda x, y: F.struct((-F.col(x)).alias("s"), F.col(y).alias("n"))
        both = F.array_sort(F.flatten(F.collect_list(F.array(pair("best", "name"), pair("second", "second_name")))))  # two of each block
        found = found.groupBy(key).agg(F.filter(both, lambda x: x["n"].isNotNull()).alias("t"))
        found = found.select(key, F.get("t", F.lit(0))["n"].alias("name"), (-F.get("t", F.lit(0))["s"]).alias("best"), F.coalesce(-F.get("t", F.lit(1))["s"], F.lit(-1.0)).alias("second"))
    close = (F.col("second") >= least) & (F.col("best") - F.col("second") < gap)
    name = F.when((F.col("best") < least) | close, "Unknown").otherwise(F.col("name"))
    return found.filter("name IS NOT NULL").select(key, name.alias("name"), F.round("best", 3).alias("score"))


def _best_two(held):
    """Batches of (key, embedding) to each key's two best profiles of a broadcast block, equal scores by name."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names, centroids = held.value
        matrix = np.array(centroids, float).reshape(len(names), len(centroids[0]) if names else 1)
        length = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
        labels = np.array([*names, None], object)
        for batch in batches:
            vectors = [v or [] for v in batch.column(1).to_pylist()]
            x = np.array([v if len(v) == matrix.shape[1] else [0.0] * matrix.shape[1] for v in vectors], float).reshape(len(vectors), matrix.shape[1])
            length = np.linalg.norm(x, axis=1, keepdims=True)
            scores = np.round(np.divide(x, length, out=np.zeros_like(x), where=length > 0) @ matrix.T, 6)
            none, row = np.full(len(x), len(names)), np.arange(len(x))
            first, second, best, next_best = none, none, np.full(len(x), -1.0), np.full(len(x), -1.0)
            if names and len(x):
                first = scores.argmax(axis=1)  # the first of equals, and names are in order
                best = scores[row, first]
                if len(names) > 1:
                    scores[row, first] = -np.inf
                    second = scores.argmax(axis=1)
                    next_best = scores[row, second]
            columns = [batch.column(0), pa.array(labels[first], pa.string()), pa.array(best), pa.array(labels[second], pa.string()), pa.array(next_best)]
            yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], "name", "best", "second_name", "second"])

    return run


def unique_assignment(candidates: DataFrame) -> DataFrame:
    """Each name to the one label that fits it best (meeting_id, label, name, confidence); other labels stay unresolved."""
    w = Window.partitionBy("meeting_id", "name").orderBy(F.desc("confidence"), "label")
    return candidates.filter("name <> 'Unknown'").withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def mean_over_ranges(pieces: DataFrame, keys: list[str], least_ms: int = 1_500, most_ms: int = 30_000) -> DataFrame:
    """The unit mean of a voice's pieces of at least least_ms, in order, until they make up most_ms."""
    d = pieces.filter(F.col("end_ms") - F.col("start_ms") >= least_ms)
    before = F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")).over(Window.partitionBy(*keys).orderBy("start_ms").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return centroids(d.withColumn("before", before).filter(F.col("before") < most_ms), keys)


def pairs_within(rows: DataFrame, group: str, order: str, vector: str = "embedding") -> DataFrame:
    """Cosine distances of all pairs of one group's vectors. Groups are meetings' lines: hundreds, not tables."""
    a = rows.select(F.col(group).alias("g"), F.col(order).alias("i"), F.col("label").alias("label_i"), F.col(vector).alias("u"))
    b = rows.select(F.col(group).alias("g"), F.col(order).alias("j"), F.col("label").alias("label_j"), F.col(vector).alias("v"))
    d = a.join(b, "g").filter("i < j")
    return d.select(F.col("g").alias(group), "i", "j", "label_i", "label_j", (1 - S.cosine(F.col("u"), F.col("v"))).alias("distance"))


def separation(pairs: DataFrame, group: str) -> DataFrame:
    """Mean distance within and across labels, and how far apart they are."""
    same = F.col("label_i") == F.col("label_j")
    d = pairs.groupBy(group).agg(F.avg(F.when(same, F.col("distance"))).alias("within"), F.avg(F.when(~same, F.col("distance"))).alias("across"), F.count_if(same).alias("same_pairs"), F.count_if(~same).alias("cross_pairs"))
    return d.withColumn("separation", F.col("across") - F.col("within"))


def single_speaker(pairs: DataFrame, group: str, p90: float = 0.38, worst: float = 0.42) -> DataFrame:
    """Whether all of a group's vectors sit within one voice: the farthest pair and the 90th percentile are near."""
    d = pairs.groupBy(group).agg(F.percentile("distance", F.lit(0.9)).alias("p90"), F.max("distance").alias("most"), F.count("*").alias("n"))
    return d.select(group, "p90", "most", ((F.col("n") < 3) | ((F.col("most") < worst) & (F.col("p90") < p90))).alias("single"))


def contingency(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of lines by both labelings (keys, label)."""
    d = a.select(*keys, F.col("label").alias("x")).join(b.select(*keys, F.col("label").alias("y")), keys)
    return d.groupBy(keys[0], "x", "y").agg(F.count("*").alias("n"))


def same_partition(table: DataFrame, group: str) -> DataFrame:
    """Whether two labelings group lines alike, whatever the labels are."""
    pairs = F.count("*")
    return table.groupBy(group).agg(((pairs == F.countDistinct("x")) & (pairs == F.countDistinct("y"))).alias("equivalent"))


def adjusted_rand(table: DataFrame, group: str) -> DataFrame:
    """The adjusted Rand index of two labelings."""
    two = lambda n: n * (n - 1) / 2
    both = table.groupBy(group).agg(F.sum(two(F.col("n"))).alias("both"), F.sum("n").alias("total"))
    rows = table.groupBy(group, "x").agg(F.sum("n").alias("n")).groupBy(group).agg(F.sum(two(F.col("n"))).alias("rows"))
    cols = table.groupBy(group, "y").agg(F.sum("n").alias("n")).groupBy(group).agg(F.sum(two(F.col("n"))).alias("cols"))
    d = both.join(rows, group).join(cols, group)
    expected = F.col("rows") * F.col("cols") / F.greatest(two(F.col("total")), F.lit(1.0))
    most = (F.col("rows") + F.col("cols")) / 2
    return d.select(group, F.when(most == expected, F.lit(1.0)).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"))


def co_membership(offline: DataFrame, streaming: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of streaming labels that one offline label would join."""
    d = offline.select(*keys, F.col("label").alias("offline")).join(streaming.select(*keys, F.col("label").alias("streaming")), keys)
    d = d.select(keys[0], "offline", "streaming").distinct()
    b = d.select(keys[0], "offline", F.col("streaming").alias("other"))
    return d.join(b, [keys[0], "offline"]).filter("streaming < other").select(keys[0], F.col("streaming").alias("a"), F.col("other").alias("b")).distinct()


def reduction_gate(joined: DataFrame, stats: DataFrame, group: str, sure: float = 0.78, never: float = 0.40) -> DataFrame:
    """Whether every join of streaming clusters is supported: alike, or undecided and one side a fragment.

    stats: group, label, centroid, count, ms, lines (all of the group), total_ms.
    """
    least_n = F.greatest(F.lit(2), F.floor(F.col("lines") / 25))
    least_ms = F.greatest(F.lit(3000.0), F.col("total_ms") / F.greatest(2 * F.col("lines"), F.lit(1)))
    s = stats.select(group, "label", "centroid", ((F.col("count") < least_n) | (F.col("ms") < least_ms)).alias("fragment"))
    a = s.select(group, F.col("label").alias("a"), F.col("centroid").alias("ca"), F.col("fragment").alias("fa"))
    b = s.select(group, F.col("label").alias("b"), F.col("centroid").alias("cb"), F.col("fragment").alias("fb"))
    d = joined.join(a, [group, "a"]).join(b, [group, "b"])
    zero = (S.norm(F.col("ca")) < 1e-6) | (S.norm(F.col("cb")) < 1e-6)
    sim = F.when(zero, F.lit(0.5)).otherwise(S.cosine(F.col("ca"), F.col("cb")))
    ok = (sim >= sure) | ((sim >= never) & (F.col("fa") | F.col("fb")))
    return d.withColumn("ok", ok).groupBy(group).agg(F.bool_and("ok").alias("supported"))


def fill_zero_vectors(rows: DataFrame, group: str, order: str, label: str = "label") -> DataFrame:
    """Rows with a zero vector take the label of the nearest row that has one, the earlier of two."""
    w = Window.partitionBy(group).orderBy(order)
    real = S.norm(F.col("embedding")) > 1e-6
    at = F.when(real, F.struct(F.col(order).alias("o"), F.col(label).alias("l")))
    before, after = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = F.when(before.isNull(), after).when(after.isNull(), before).when(F.col(order) - before["o"] <= after["o"] - F.col(order), before).otherwise(after)
    return rows.withColumn("filled_label", F.when(real, F.col(label)).otherwise(near["l"]))


def relabel(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Speaker_NN by first appearance; overlapping rows keep what they have, the others lose their identity."""
    first = rows.groupBy(group, "label").agg(F.min(order).alias("first"))
    named = first.withColumn("new_label", F.format_string("Speaker_%02d", F.row_number().over(Window.partitionBy(group).orderBy("first")) - 1)).drop("first")
    d = rows.join(named, [group, "label"])
    return d.withColumn("speaker_label", F.when(F.col("is_overlap"), F.col("speaker_label")).otherwise(F.col("new_label"))).withColumn("identified_as", F.when(F.col("is_overlap"), F.col("identified_as")).otherwise("Unknown")).drop("new_label")


def nearest_candidate(spans: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Each separated voice (keys, span, embedding) with its nearest candidate; a second claim on one candidate is void."""
    d = spans.join(candidates, keys).withColumn("score", S.cosine(F.col("embedding"), F.col("centroid")))
    best = d.groupBy(*keys, "span").agg(F.max_by("name", "score").alias("name"), F.max("score").alias("score"))
    w = Window.partitionBy(*keys, "name").orderBy(F.desc("score"), "span")
    return best.withColumn("name", F.when(F.row_number().over(w) == 1, F.col("name")))


def prune_candidates(rows: DataFrame, counts: Column, clusters: Column) -> DataFrame:
    """Overlap candidates with a single sample dropped where there are several clusters; under two left is no overlap.

    rows has candidate_labels; counts is a map of label to samples, clusters their number.
    """
    kept = F.when(clusters > 1, F.filter("candidate_labels", lambda c: F.coalesce(F.try_element_at(counts, c), F.lit(0)) >= 2)).otherwise(F.col("candidate_labels"))
    d = rows.withColumn("kept", kept)
    two = F.size("kept") >= 2
    return d.withColumns({"is_overlap": two, "speaker_label": F.when(two, F.array_join("kept", " + ")).otherwise(F.coalesce(F.try_element_at("kept", F.lit(1)), F.try_element_at("candidate_labels", F.lit(1)))), "confidence": F.when(two, F.lit(0.5))}).drop("kept")


def _follow(merges: DataFrame) -> DataFrame:
    """Each label's pointer followed as many times as there are labels, by doubling; every round is written."""
    d = materialise(merges.select("absorbed", F.col("kept").alias("survivor")), "merge-chains")
    for _ in range(d.count().bit_length()):
        further = d.select(F.col("absorbed").alias("survivor"), F.col("survivor").alias("further"))
        d = materialise(d.join(further, "survivor", "left").select("absorbed", F.coalesce("further", "survivor").alias("survivor")), "merge-chains")
    return d


def survivors(merges: DataFrame) -> DataFrame:
    """(absorbed, kept) pairs, one for each absorbed label, to each label's last survivor.

    Labels on a cycle survive as themselves, and what leads into a cycle ends at the label where it enters.
    """
    far = _follow(merges)
    looped = far.select("survivor").distinct().join(merges.select(F.col("absorbed").alias("survivor")), "survivor", "left_semi")
    tails = merges.join(looped.select(F.col("survivor").alias("absorbed")), "absorbed", "left_anti")
    return _follow(tails).unionAll(looped.select(F.col("survivor").alias("absorbed"), "survivor"))


def count_errors(found: DataFrame) -> DataFrame:
    """(threshold, expected, speakers): mean absolute error and exact counts of each threshold, best first."""
    d = found.groupBy("threshold").agg(F.avg(F.abs(F.col("speakers") - F.col("expected"))).alias("mae"), F.count_if(F.col("speakers") == F.col("expected")).alias("exact"))
    return d.orderBy("mae", "threshold")
