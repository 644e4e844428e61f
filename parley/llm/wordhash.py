"""64-bit hashes of word windows by prefix sums over the hashes of their words."""

from __future__ import annotations

import numpy as np

U = np.uint64
WORD_BASE = 0xD6E8FEB86659FD93


def _mix(h):
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int):
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, base, U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


def text_buffers(column):
    """(bytes, offsets) of an Arrow string column; nulls are empty."""
    import pyarrow as pa

    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.cast(pa.large_utf8()).fill_null("")
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.large_utf8())
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8), offsets


def window_hashes(words, counts, size: int, powers: Powers):
    """(hash, index of the first word, text index) of every window of `size` words that lies within one text."""
    n = len(words)
    if n < size:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, U), empty, empty
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(np.arange(n) + size <= ends[text])
    up, down = powers.upto(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(words * up[:n], out=sums[1:])
    return _mix((sums[at + size] - sums[at]) * down[at]), at, text[at]
