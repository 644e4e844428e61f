"""Segmentation lattices of a SentencePiece vocabulary, for many texts at once, in numpy.

A text is normalised as the model does it: one blank in front, blanks as U+2581. No piece of such a
vocabulary holds a blank after a letter, and some characters are in no piece at all, so the lattice falls
apart into units: words with the blanks before them, and single characters spelled as bytes. A text's
segmentations are the products of its units' segmentations, and a unit that occurs often is solved once.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BLANK = 0x2581
#: Stands for a U+2581 of the text itself, which is spelled as bytes so that decoding tells it from a blank.
LITERAL_BLANK = 0x110000


def mix(h):
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def uniform(seed, counter):
    """Uniform doubles in (0, 1) from a seed and a counter, whatever batch they are drawn in."""
    return ((mix(seed ^ mix(counter + U(0x9E3779B97F4A7C15))) >> U(12)).astype(np.float64) + 0.5) / float(1 << 52)


class Pieces:
    """A vocabulary as a trie in flat arrays, with log probabilities.

    Ranks stand in for frequencies (Zipf): a merge-based vocabulary scores pieces by rank alone. Pieces that
    spell bytes serve characters without a piece of their own, at the price of a rare piece each.
    """

    def __init__(self, pieces: list[str], scores: list[float], is_byte: list[bool], is_special: list[bool], alpha: float = 1.0):
        n = len(pieces)
        ranks = np.clip(-np.array(scores), 1, n)
        plain = np.array([not (b or s) for b, s in zip(is_byte, is_special, strict=True)])
        weight = np.where(plain, 1 / (ranks + 2.7), 0)
        self.log_p = alpha * np.log(np.maximum(weight / weight.sum(), 1e-12))
        self.byte_id = {int(p[3:5], 16): i for i, (p, b) in enumerate(zip(pieces, is_byte, strict=True)) if b}
        self.byte_cost = float(self.log_p[plain].min() - alpha)
        self.text = [bytes([int(p[3:5], 16)]) if b else b"" if s else p.replace("▁", " ").encode() for p, b, s in zip(pieces, is_byte, is_special, strict=True)]
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        self.width = np.array([len(t) for t in self.text], np.int64)
        self.place = np.cumsum(self.width) - self.width
        self.byte_ids = np.array([self.byte_id.get(b, 0) for b in range(256)], np.int64)
        self.longest = max(len(p) for p, k in zip(pieces, plain, strict=True) if k)
        steps, accept, covered = {}, [-1], set()
        for i, piece in enumerate(pieces):
            if plain[i]:
                state = 0
                for c in map(ord, piece):
                    covered.add(c)
                    nxt = steps.get((state, c))
                    if nxt is None:
                        nxt = steps[(state, c)] = len(accept)
                        accept.append(-1)
                    state = nxt
                accept[state] = i
        if any("▁" in p.lstrip("▁") for p, k in zip(pieces, plain, strict=True) if k):
            raise ValueError("a piece holds a blank after a letter, so units cannot be told apart")
        self.accept = np.array(accept, np.int64)
        self.covered = np.zeros(LITERAL_BLANK + 1, bool)
        self.covered[list(covered)] = True
        self.bits = int(np.ceil(np.log2(len(steps)))) + 2
        self.keys, self.next = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        keys = np.array([(s << 21) | c for s, c in steps], np.int64)
        for key, slot, value in zip(keys.tolist(), self._slot(keys).tolist(), steps.values(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.next[slot] = key, value

    @classmethod
    def load(cls, path: str, alpha: float = 1.0) -> Pieces:
        """Read a model file (on the driver; executors get the arrays)."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.vocab_size())
        return cls([m.id_to_piece(i) for i in ids], [m.get_score(i) for i in ids], [m.is_byte(i) for i in ids], [m.is_control(i) or m.is_unknown(i) for i in ids], alpha)

    def _slot(self, keys):
        return ((keys.astype(U) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def step(self, states, codes):
        """The next state of each, -1 where the trie has none."""
        keys = (states << 21) | codes
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.next[slot], -1)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.next[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out

    def decode(self, ids) -> str:
        """The text that ids spell, without the blank that encoding puts in front."""
        joined = b"".join([self.text[i] for i in ids])
        return joined[1:].decode() if joined[:1] == b" " else joined.decode()

    def decode_many(self, ids, ends):
        """The bytes that the ids of several rows spell, blank in front included, and where each row's bytes end."""
        width = self.width[ids]
        stop = np.concatenate(([0], np.cumsum(width)))
        at = np.repeat(self.place[ids] - stop[:-1], width) + np.arange(int(stop[-1]))
        return self.flat[at], stop[ends]


def codes_of(text: str):
    """The characters of a text as the model sees them; none for an empty text."""
    if not text:
        return np.zeros(0, np.int64)
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.concatenate(([BLANK], np.where(c == 32, BLANK, np.where(c == BLANK, LITERAL_BLANK, c))))


class Solved:
    """Solved units, kept from batch to batch and found again by a hash of their characters.

    Nodes are places after a character of a unit; edges are pieces that end there, longest first, with the chance
    of coming from each (`prob`, summed up in `cum`) when a segmentation is drawn from right to left. A unit's
    numbers depend on its characters alone, so neither its place here nor forget() shows in any result.
    """

    EDGES = {"source": np.int32, "target": np.int32, "piece": np.int32, "prob": np.float64, "cum": np.float64}
    NODES = {"first": np.int32, "stop": np.int32, "begin": np.int32}
    UNITS = {"base": np.int32, "size": np.int32}

    def __init__(self, vocab: Pieces, most_edges: int = 1 << 21):
        self.vocab, self.most_edges = vocab, most_edges
        self.forget()

    def forget(self) -> None:
        self._room = {name: np.zeros(0, kind) for kinds in (self.EDGES, self.NODES, self.UNITS) for name, kind in kinds.items()}
        for name, room in self._room.items():
            setattr(self, name, room)
        self._table(1 << 12)

    def _append(self, **arrays) -> None:
        """Add to arrays that grow by half at least, so that a batch copies only what it adds."""
        for name, x in arrays.items():
            old, room = getattr(self, name), self._room[name]
            n = len(old) + len(x)
            if n > len(room):
                room = self._room[name] = np.empty(n + n // 2, room.dtype)
                room[: len(old)] = old
            room[len(old) : n] = x
            setattr(self, name, room[:n])

    def _table(self, slots: int) -> None:
        self.slots = slots
        self.names, self.where = np.zeros(slots, U), np.full(slots, -1, np.int64)

    def _find(self, keys):
        """The unit of each key, -1 where it is unknown."""
        slot = (keys & U(self.slots - 1)).astype(np.int64)
        out = self.where[slot]
        todo = np.flatnonzero((self.names[slot] != keys) & (out >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (self.slots - 1)
            out[todo] = self.where[slot[todo]]
            todo = todo[(self.names[slot[todo]] != keys[todo]) & (out[todo] >= 0)]
        return out

    def _enter(self, keys, units) -> None:
        """Enter distinct keys that are not there yet."""
        if 2 * (len(self.base) + len(keys)) > self.slots:
            known = self.where >= 0
            keys, units = np.concatenate([self.names[known], keys]), np.concatenate([self.where[known], units])
            self._table(1 << int(4 * len(keys)).bit_length())
        slot = (keys & U(self.slots - 1)).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.where[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)  # one key to a free slot
            taken = free[one]
            self.names[slot[taken]], self.where[slot[taken]] = keys[taken], units[taken]
            rest = np.ones(len(keys), bool)
            rest[taken] = False
            keys, units, slot = keys[rest], units[rest], (slot[rest] + 1) & (self.slots - 1)

    def units(self, keys, start, length, codes):
        """The unit of every key; those not known are solved. A key's characters lie in codes at start, for length."""
        if len(self.source) > self.most_edges:
            self.forget()
        kind = self._find(keys)
        new = np.flatnonzero(kind < 0)
        if len(new):
            fresh, at, inverse = np.unique(keys[new], return_index=True, return_inverse=True)
            at = new[at]
            base = len(self.base)
            self._solve(length[at], codes[np.repeat(start[at] - (np.cumsum(length[at]) - length[at]), length[at]) + np.arange(int(length[at].sum()))])
            self._enter(fresh, base + np.arange(len(fresh)))
            kind[new] = base + inverse
        return kind

    def _solve(self, size, c):
        """Add units whose characters lie side by side in c."""
        vocab, n = self.vocab, len(c)
        base = np.cumsum(size) - size
        begin = np.repeat(base, size)
        end = begin + np.repeat(size, size)
        states, at = np.zeros(n, np.int64), np.arange(n)
        found = []
        for k in range(1, vocab.longest + 1):
            states = vocab.step(states, c[at + k - 1])
            ok = states >= 0
            states, at = states[ok], at[ok]
            piece = vocab.accept[states]
            hit = piece >= 0
            found.append((at[hit], at[hit] + k, piece[hit]))
            more = at + k < end[at]
            states, at = states[more], at[more]
            if not len(at):
                break
        single = np.zeros(n, bool)
        if found:
            single[found[0][0]] = True
        bare = np.flatnonzero(~single)
        found.append((bare, bare + 1, -1 - c[bare]))
        source, target, piece = (np.concatenate([f[i] for f in found]) for i in range(3))
        spelled = piece < 0
        code = np.where(spelled, -1 - piece, 0)
        n_bytes = 1 + (code > 0x7F) + (code > 0x7FF) + ((code > 0xFFFF) & (code != LITERAL_BLANK))
        score = np.where(spelled, vocab.byte_cost * n_bytes, vocab.log_p[np.maximum(piece, 0)])
        level = target - begin[target - 1]
        order = np.argsort((level * (n + 1) + target) * 32 + 31 - (target - source))  # of a node, the longest piece first
        source, target, piece, score, level = source[order], target[order], piece[order], score[order], level[order]
        root = source == begin[target - 1]
        prob, alpha = np.empty(len(source)), np.zeros(n)
        group = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1]))) if n else np.zeros(0, np.int64)
        ends = np.append(group, len(target))[1:]
        width, node = ends - group, target[group] - 1
        edges = np.searchsorted(level, np.arange(1, int(level.max(initial=0)) + 2))
        groups = np.searchsorted(group, edges)
        for lo, hi, a, b in zip(edges[:-1], edges[1:], groups[:-1], groups[1:], strict=True):
            v = score[lo:hi] + np.where(root[lo:hi], 0.0, alpha[source[lo:hi] - 1])
            first = group[a:b] - lo
            top = np.maximum.reduceat(v, first)
            e = np.exp(v - np.repeat(top, width[a:b]))
            total = np.add.reduceat(e, first)
            alpha[node[a:b]] = top + np.log(total)
            prob[lo:hi] = e / np.repeat(total, width[a:b])
        prob[group[width == 1]] = 1.0
        cum, here, stops, total = prob.copy(), group, ends, np.zeros(len(group))
        while len(here):  # each node summed by itself, so that no digit depends on its neighbours
            total = total + prob[here]
            cum[here] = total
            on = here + 1 < stops
            here, stops, total = here[on] + 1, stops[on], total[on]
        cum[ends - 1] = 2.0
        nodes, before = len(self.begin), len(self.source)
        first, stop = np.zeros(n, np.int64), np.zeros(n, np.int64)
        first[node], stop[node] = before + group, before + ends
        self._append(source=source + nodes, target=target + nodes, piece=piece, prob=prob, cum=cum, first=first, stop=stop, begin=begin + nodes, base=base + nodes, size=size)


class Units:
    """The units of some texts: which solved unit each one is (`kind`) and which text it stands in (`text_of`)."""

    def __init__(self, solved: Solved, texts: list[str]):
        self.solved, self.vocab = solved, solved.vocab
        vocab = self.vocab
        parts = [codes_of(t) for t in texts]
        lengths = np.array([len(p) for p in parts], np.int64)
        codes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        cut = np.ones(len(codes), bool)
        if len(codes):
            alone = ~vocab.covered[codes]
            cut[1:] = ((codes[1:] == BLANK) & (codes[:-1] != BLANK)) | alone[1:] | alone[:-1]
            starts_of_texts = (np.cumsum(lengths) - lengths)[lengths > 0]
            cut[starts_of_texts] = True
        start = np.flatnonzero(cut)
        length = np.diff(np.append(start, len(codes)))
        self.text_of = np.searchsorted(np.cumsum(lengths), start, side="right")
        # a unit is known by a 64-bit hash of its characters and length
        odd = np.full(max(1, int(length.max(initial=1))), 0x9E3779B97F4A7C15, U)
        odd[0] = 1
        powers = np.multiply.accumulate(odd)
        within = np.arange(len(codes)) - np.repeat(start, length)
        terms = np.concatenate((np.zeros(1, U), np.cumsum(mix(codes.astype(U) + U(1)) * powers[within])))
        keys = mix(terms[start + length] - terms[start] + length.astype(U))
        self.kind = solved.units(keys, start, length, codes)
        for kinds in (Solved.EDGES, Solved.NODES, Solved.UNITS):
            for name in kinds:
                setattr(self, name, getattr(solved, name))

    def draw(self, units, nodes, seeds, counter):
        """Draw from right to left: each of `units` from its node down. (unit position in `units`, step, edge) of all steps."""
        who, out = np.flatnonzero(nodes >= self.base[self.kind[units]]), []
        nodes = nodes[who]
        step = 0
        while len(who):
            r = uniform(seeds[who], counter[who] + U(step))
            edge = self.first[nodes].astype(np.int64)
            todo = np.flatnonzero(r >= self.cum[edge])
            while len(todo):
                edge[todo] += 1
                todo = todo[r[todo] >= self.cum[edge[todo]]]
            out.append((who, np.full(len(who), step), edge))
            on = self.source[edge] > self.begin[nodes]
            who, nodes = who[on], self.source[edge[on]].astype(np.int64) - 1
            step += 1
        return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))

    def tops(self, units):
        """The last node of each unit, where a draw begins."""
        kind = self.kind[units]
        return self.base[kind].astype(np.int64) + self.size[kind] - 1

    def spell(self, edges):
        """Piece ids of edges in text order, bytes spelled out, and how many each edge gave."""
        piece = self.piece[edges].astype(np.int64)
        bare = np.flatnonzero(piece < 0)
        count = np.ones(len(piece), np.int64)
        if not len(bare):
            return piece, count
        code = -1 - piece[bare]
        code[code == LITERAL_BLANK] = BLANK
        kinds, which = np.unique(code, return_inverse=True)  # few characters, each spelled once
        spelled = [self.vocab.byte_ids[list(chr(c).encode())] for c in kinds.tolist()]
        count[bare] = np.array([len(x) for x in spelled])[which]
        out = np.repeat(piece, count)
        flat, sizes = np.concatenate(spelled), np.array([len(x) for x in spelled])
        begin = np.cumsum(sizes) - sizes
        n = sizes[which]
        out[np.repeat(piece < 0, count)] = flat[np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return out, count
