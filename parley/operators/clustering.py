"""Clustering of one recording's voice vectors: online as they come, offline by average linkage.

Both depend on order or on all pairs of one recording, hundreds of vectors, so each recording is one group;
recordings run side by side. numpy only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Limits:
    """Fixed values of the online rules."""

    base: float = 0.55
    growth: float = 0.01
    ceiling: float = 0.58
    blend: float = 0.15
    merge: float = 0.55
    merge_floor: float = 0.40
    merge_every: int = 10
    samples: int = 24
    evidence: int = 3
    margin: float = 0.08
    spread_factor: float = 0.1
    short: float = 1.8
    short_far: float = 0.85
    gate_short: float = 3.0
    gate: float = 0.52
    consistent: float = 0.25
    candidates: int = 20
    attach_short_below: float | None = None


def distances(a, b):
    """Cosine distances between rows of a and rows of b; 1 to a zero vector."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    scale = np.outer(na, nb)
    return 1 - np.divide(a @ b.T, scale, out=np.zeros(scale.shape), where=scale > 0)


def _unit(v):
    return v / (np.linalg.norm(v) + 1e-9)


@dataclass
class Voice:
    center: np.ndarray
    count: int = 1
    samples: list = field(default_factory=list)


class Online:
    """Speakers found one segment at a time."""

    def __init__(self, limits: Limits = Limits()):
        self.k, self.voices, self.next_id = limits, {}, 0
        self.last, self.outliers, self.since_merge = None, [], 0

    def state(self) -> tuple:
        """All that is known so far, as plain values and arrays."""
        return self.next_id, self.last, self.outliers, self.since_merge, {x: (v.center, v.count, v.samples) for x, v in self.voices.items()}

    @classmethod
    def resume(cls, limits: Limits, state: tuple) -> Online:
        live = cls(limits)
        live.next_id, live.last, live.outliers, live.since_merge, voices = state
        live.voices = {x: Voice(*v) for x, v in voices.items()}
        return live

    def _threshold(self, label):
        return min(self.k.base + self.voices[label].count * self.k.growth, self.k.ceiling)

    def _distance(self, v, label):
        voice = self.voices[label]
        return float(distances(v[None], np.stack([voice.center, *voice.samples])).min())

    def _open(self, v):
        label = f"Speaker_{self.next_id:02d}"
        self.next_id += 1
        self.voices[label] = Voice(v.copy(), 1, [v.copy()])
        self.last = label
        return label

    def _learn(self, label, v):
        voice = self.voices[label]
        voice.center = _unit(self.k.blend * v + (1 - self.k.blend) * voice.center)
        voice.count += 1
        voice.samples = [*voice.samples, v.copy()][-self.k.samples :]
        self.last = label

    def _merge_check(self, now=False):
        self.since_merge = self.k.merge_every if now else self.since_merge + 1
        if self.since_merge < self.k.merge_every:
            return
        self.since_merge = 0
        labels = list(self.voices)
        if len(labels) < 2:
            return
        d = distances(*[np.stack([self.voices[x].center for x in labels])] * 2)
        near = min(self.k.merge, max(float(np.percentile(d[np.triu_indices(len(labels), 1)], 30)), self.k.merge_floor))
        for i, a in enumerate(labels):
            for b in labels[i + 1 :]:
                if a in self.voices and b in self.voices and float(distances(self.voices[a].center[None], self.voices[b].center[None])[0, 0]) < near:
                    keep, gone = self.voices[a], self.voices.pop(b)
                    total = keep.count + gone.count
                    keep.center = _unit((keep.center * keep.count + gone.center * gone.count) / total)
                    keep.count, keep.samples = total, [*keep.samples, *gone.samples][-self.k.samples :]
                    self.last = a if self.last == b else self.last

    def _overlap(self, v, dist):
        near = dist
        if len(self.voices) >= 3:
            near = {x: d for x, d in dist.items() if self.voices[x].count >= 2 or x == self.last}
            near = near if len(near) >= 2 else dist
        if len(near) < 2:
            return None
        (a, da), (b, db) = sorted(near.items(), key=lambda kv: kv[1])[:2]
        if da > self._threshold(a) + 0.05 or db > self._threshold(b) + 0.05:
            return None
        mixture = _unit(self.voices[a].center + self.voices[b].center)
        dm = float(distances(v[None], mixture[None])[0, 0])
        even = db - da <= 0.04 and (db - da) / max(da, 1e-5) <= 0.15
        return (a, b) if even or dm < min(da, db) - 0.01 else None

    def _defer(self, best, d, duration):
        if d - self._threshold(best) < self.k.margin:
            return True
        if len(self.voices) == 1:
            voice = self.voices[best]
            all_ = np.stack([*voice.samples, voice.center])
            spread = float(np.percentile(distances(all_, all_)[np.triu_indices(len(all_), 1)], 75)) if len(all_) > 1 else 0.0
            if d < self._threshold(best) + spread * self.k.spread_factor:
                return True
        return duration < self.k.short and d < self.k.short_far

    def _promote(self, v):
        if len(self.outliers) < self.k.evidence:
            return None
        recent = self.outliers[-self.k.evidence :]
        group = np.stack([o[0] for o in recent] + [v])
        if float(distances(group, group)[np.triu_indices(len(group), 1)].mean()) > self.k.consistent:
            return None
        assigned = recent[0][1]
        if assigned not in self.voices or np.mean([self._distance(g, assigned) for g in group]) < self._threshold(assigned):
            return None
        self.outliers = []
        return self._open(v)

    def add(self, start: float, end: float, v) -> tuple[str, list[str], str]:
        """(label, candidate labels, what was done) for the next segment."""
        v = np.asarray(v, np.float64)
        if not self.voices:
            return (label := self._open(v)), [label], "new"
        dist = {x: self._distance(v, x) for x in self.voices}
        best = min(dist, key=dist.get)
        if pair := self._overlap(v, dist):
            self.last = pair[0]
            return " & ".join(pair), list(pair), "overlap"
        d, duration = dist[best], end - start
        if d < self._threshold(best):
            self._learn(best, v)
            self._merge_check()
            return best, [best], "match"
        if self.k.attach_short_below is not None and duration < self.k.attach_short_below:
            self.last = best
            return best, [best], "short"
        if self._defer(best, d, duration):
            self.outliers = [*self.outliers, (v.copy(), best)][-self.k.candidates :]
            self.last = best
            return best, [best], "deferred"
        if label := self._promote(v):
            self._merge_check()
            return label, [label], "promoted"
        if (duration < self.k.gate_short or len(self.outliers) < self.k.evidence) and d < self.k.gate:
            self._learn(best, v)
            return best, [best], "forced"
        label = self._open(v)
        self.outliers = []
        self._merge_check(now=True)
        return label, [label], "new"


ONLINE = "position int, speaker_label string, candidate_labels array<string>, action string, is_overlap boolean"


def online_labels(segments: DataFrame, group: str = "meeting_id", limits: Limits = Limits()) -> DataFrame:
    """Segments (group, position, start_sec, end_sec, embedding) labelled in order of start."""

    def run(pdf):
        import pandas as pd

        state, out = Online(limits), []
        for r in pdf.sort_values(["start_sec", "position"]).itertuples(index=False):
            label, candidates, action = state.add(r.start_sec, r.end_sec, r.embedding)
            out.append((pdf[group].iloc[0], r.position, label, candidates, action, action == "overlap"))
        return pd.DataFrame(out, columns=[group, "position", "speaker_label", "candidate_labels", "action", "is_overlap"])

    return segments.groupBy(group).applyInPandas(run, f"{group} {dict(segments.dtypes)[group]}, {ONLINE}")


def linkage(d):
    """Average linkage: merges (a, b, distance) in order, new clusters numbered from n on."""
    n = len(d)
    d = d.astype(np.float64).copy()
    np.fill_diagonal(d, np.inf)
    size, name, merges = np.ones(n), list(range(n)), []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = min(i, j), max(i, j)
        merges.append((name[i], name[j], float(d[i, j])))
        mean = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = mean, mean
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        alive[j] = False
        size[i] += size[j]
        name[i] = n + step
    return merges


def cut(merges, n: int, k: int | None = None, distance: float | None = None):
    """Labels 0.. by first appearance after the first n - k merges, or those closer than a distance."""
    parent = list(range(2 * n))
    for step, (a, b, d) in enumerate(merges):
        if (k is not None and step >= n - k) or (distance is not None and d >= distance):
            break
        parent[a] = parent[b] = n + step
    find = lambda x: x if parent[x] == x else find(parent[x])
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(find(i), len(seen)) for i in range(n)])


def silhouette(d, labels):
    """The mean silhouette; members of single clusters count 0."""
    k = labels.max() + 1
    member = np.eye(k)[labels]
    sizes = member.sum(axis=0)
    sums = d @ member
    own = sums[np.arange(len(d)), labels] / np.maximum(sizes[labels] - 1, 1)
    other = np.where(member > 0, np.inf, sums / sizes).min(axis=1)
    s = np.where(sizes[labels] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-12), 0.0)
    return float(s.mean())


def pick_count(vectors, k_max: int = 12, floor: float = 0.18, near: float = 0.001):
    """(k, score, labels) with the smallest k whose silhouette is near the best; None below the floor or for under 3 vectors."""
    n = len(vectors)
    if n < 3:
        return None
    d = np.clip(distances(vectors, vectors), 0, None)
    np.fill_diagonal(d, 0)
    merges = linkage(d)
    scored = [(k, silhouette(d, labels := cut(merges, n, k=k)), labels) for k in range(2, min(k_max, n - 1) + 1)]
    if not scored:
        return None
    peak = max(s for _, s, _ in scored)
    best = next(x for x in scored if x[1] >= peak - near)
    return best if best[1] >= floor else None


def by_distance(vectors, distance: float = 0.48):
    """(k, score, labels) with the number of clusters left to a distance."""
    n = len(vectors)
    if n < 2:
        return 1, 1.0, np.zeros(n, int)
    d = np.clip(distances(vectors, vectors), 0, None)
    np.fill_diagonal(d, 0)
    labels = cut(linkage(d), n, distance=distance)
    k = int(labels.max() + 1)
    return k, silhouette(d, labels) if 1 < k < n else 0.0, labels


def _voices(vectors, labels, seconds):
    out = {}
    for c in sorted(set(labels.tolist())):
        rows = np.flatnonzero(labels == c)
        real = rows[np.linalg.norm(vectors[rows], axis=1) > 1e-6]
        out[c] = (_unit(vectors[real].mean(axis=0)) if len(real) else np.zeros(vectors.shape[1]), len(rows), float(seconds[rows].sum()))
    return out


def _least(seconds):
    n = len(seconds)
    return max(2, n // 25), max(3.0, float(seconds.sum()) / max(2 * n, 1))


def _apart(a, b):
    return 1.0 if np.linalg.norm(a) < 1e-6 or np.linalg.norm(b) < 1e-6 else float(distances(a[None], b[None])[0, 0])


def merge_fragments(vectors, labels, seconds, most: float = 0.55):
    """Clusters with too few lines or seconds joined to their nearest neighbour, least first, until none is near enough."""
    labels = labels.copy()
    lines, secs = _least(seconds)
    while True:
        voices = _voices(vectors, labels, seconds)
        if len(voices) < 2:
            break
        centers = [c for c, _, _ in voices.values() if np.linalg.norm(c) > 1e-6]
        near = most
        if len(centers) > 1:
            d = distances(*[np.stack(centers)] * 2)
            near = min(most, float(np.percentile(d[np.triu_indices(len(centers), 1)], 30)))
        for c in sorted(voices, key=lambda x: (voices[x][2], voices[x][1])):
            center, n, s = voices[c]
            if n >= lines and s >= secs:
                continue
            gap, to = min((_apart(center, voices[o][0]), o) for o in voices if o != c)
            if gap < 1.0 and gap <= (max(near, 0.65) if s < 4.0 or n < 2 else near):
                labels[labels == c] = to
                break
        else:
            break
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(int(c), len(seen)) for c in labels])


def reduction_ok(vectors, streaming, offline, seconds, sure: float = 0.78, never: float = 0.40) -> bool:
    """Whether every pair of streaming clusters that offline joins is one voice, or undecided and one side a fragment."""
    voices = _voices(vectors, streaming, seconds)
    lines, secs = _least(seconds)
    fragment = {c: n < lines or s < secs for c, (_, n, s) in voices.items()}
    for c in set(offline.tolist()):
        members = sorted(set(streaming[offline == c].tolist()))
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                zero = min(np.linalg.norm(voices[a][0]), np.linalg.norm(voices[b][0])) < 1e-6
                sim = 0.5 if zero else 1 - _apart(voices[a][0], voices[b][0])
                if sim < never or (sim < sure and not (fragment[a] or fragment[b])):
                    return False
    return True


def one_voice(vectors, p90: float = 0.38, worst: float = 0.42) -> bool:
    """Whether all vectors sit within one voice's variation."""
    real = vectors[np.linalg.norm(vectors, axis=1) > 1e-6]
    if len(real) < 3:
        return True
    d = distances(real, real)[np.triu_indices(len(real), 1)]
    return bool(d.max() < worst and np.percentile(d, 90) < p90)


def recluster(vectors, streaming, seconds, k_max: int = 12):
    """(labels or None for unchanged, why): the whole offline decision for one recording."""
    first: dict = {}
    stream = np.array([first.setdefault(s, len(first)) for s in streaming])
    real = np.linalg.norm(vectors, axis=1) > 1e-6
    if real.sum() < 3:
        return None, "too_few"
    if len(first) > 1 and one_voice(vectors):
        return np.zeros(len(vectors), int), "single_speaker"
    picked = pick_count(vectors[real], k_max, 0.28 if len(first) <= 1 else 0.18)
    if picked is None:
        labels, why = stream.copy(), "kept_streaming"
    else:
        labels = np.zeros(len(vectors), int)
        at = np.flatnonzero(real)
        labels[at] = picked[2]
        for i in np.flatnonzero(~real):
            labels[i] = labels[at[np.argmin(np.abs(at - i))]]
        why = "silhouette"
        if picked[0] < len(first) and not reduction_ok(vectors, stream, labels, seconds):
            labels, why = stream.copy(), "reduction_refused"
    labels = merge_fragments(vectors, labels, seconds)
    if len(set(zip(stream.tolist(), labels.tolist(), strict=True))) == len(first) == len(set(labels.tolist())):
        return None, "equivalent"
    return labels, why


def offline_labels(segments: DataFrame, group: str = "meeting_id", k_max: int = 12) -> DataFrame:
    """Segments (group, position, start_sec, end_sec, speaker_label, embedding) with offline labels where they differ."""

    def run(pdf):
        import pandas as pd

        d = pdf.sort_values("position")
        vectors = np.stack(d["embedding"].to_list()).astype(np.float64)
        labels, why = recluster(vectors, d["speaker_label"].tolist(), np.maximum(d["end_sec"] - d["start_sec"], 0).to_numpy(), k_max)
        seen: dict = {}
        names = d["speaker_label"].tolist() if labels is None else [f"Speaker_{seen.setdefault(int(c), len(seen)):02d}" for c in labels]
        return pd.DataFrame({group: d[group], "position": d["position"], "speaker_label": names, "reason": why, "changed": labels is not None})

    return segments.groupBy(group).applyInPandas(run, f"{group} {dict(segments.dtypes)[group]}, position int, speaker_label string, reason string, changed boolean")


def distance_sweep(segments: DataFrame, thresholds: list[float], group: str = "meeting_id") -> DataFrame:
    """(group, threshold, speakers, silhouette) over a grid of distances, each recording's distances computed once."""

    def run(pdf):
        import pandas as pd

        vectors = np.stack(pdf.sort_values("position")["embedding"].to_list()).astype(np.float64)
        rows = [(pdf[group].iloc[0], t, *by_distance(vectors, t)[:2]) for t in thresholds]
        return pd.DataFrame(rows, columns=[group, "threshold", "speakers", "silhouette"])

    return segments.groupBy(group).applyInPandas(run, f"{group} {dict(segments.dtypes)[group]}, threshold double, speakers int, silhouette double")
