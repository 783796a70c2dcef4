"""Vectorised helpers over the UTF-8 bytes of an Arrow text column.

Everything here works on a *block*: the bytes of several documents laid end to end
(``data``) with ``offsets`` marking where each begins, so that numpy does the work of a
batch in a few passes.  ``blocks`` bounds a block's bytes, hence memory, whatever the
Arrow batch holds; only a single document longer than the bound makes a larger block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 17

_STEP = np.uint64(0xA24BAED4963EE407)
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

#: The white space of the word contract: blank and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, data, offsets) of runs of rows of at most ``limit`` bytes; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1)
        yield start, end, data[bounds[start] : bounds[end]], bounds[start : end + 1] - bounds[start]
        start = end


def fold_ascii(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z in lower case and every other byte as it is."""
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << 5)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Spans:
    """Hashes of spans of a sequence of whole numbers: equal spans have equal hashes wherever they stand.

    The hash of 2^j values is scrambled from those of its halves, and a span's from the
    powers of two that its length is made of.  Nothing in this is linear in the values, so
    that no pattern of the text (as in sums of powers, where Thue-Morse strings of any base
    meet) makes spans collide.  ``seed`` 0 and 1 give two hashes that are independent.
    """

    def __init__(self, values: np.ndarray, seed: int = 0) -> None:
        self.seed = _SEEDS[seed]
        self.single = mix(values.astype(np.uint64) + self.seed)

    def _levels(self, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        level, size = self.single, 1
        while size <= longest:
            yield size, level
            if 2 * size <= longest:
                level = mix(level[:-size] * _STEP + level[size:])
            size *= 2

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = np.asarray(end - start, np.int64)
        value, at = mix(length.astype(np.uint64) * _STEP + self.seed), np.array(start, np.int64)
        for size, level in self._levels(int(length.max()) if len(length) else 0):
            some = np.flatnonzero(length & size)
            value[some] = mix(value[some] * _STEP + level[at[some]])
            at[some] += size
        return value

    def every(self, length: int) -> np.ndarray:
        """The hash of each span of ``length`` values, by start."""
        n = len(self.single) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        value, at = mix(np.full(1, length, np.uint64) * _STEP + self.seed), 0
        for size, level in self._levels(length):
            if length & size:
                value = mix(value * _STEP + level[at : at + n])
                at += size
        return value


def segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of segments that ascend and do not overlap: the scrambled sum of a scrambled number for each value at its place."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lo, hi = int(starts[0]), int(ends[-1])
    place = np.arange(lo, hi) - np.repeat(starts, np.diff(np.append(starts, hi)))
    own = np.append(mix((place.astype(np.uint64) << np.uint64(24)) + values[lo:hi].astype(np.uint64) + _SEEDS[0]), np.uint64(0))
    edges = np.empty(2 * len(starts), np.int64)
    edges[0::2], edges[1::2] = starts - lo, ends - lo
    total = np.add.reduceat(own, edges)[0::2]
    total[starts == ends] = 0
    return mix(total + (ends - starts).astype(np.uint64) * _STEP)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words of a block; a word is a run without white space."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = SPACE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = gap[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = True
    starts = np.flatnonzero(first & ~gap)
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = gap[1:]
    last[inner - 1] = True
    ends = np.flatnonzero(last & ~gap) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct ``width``-word shingles of each document, ascending, laid end to end.

    A document with fewer words than ``width`` has its whole word sequence as its one
    shingle; one without words has none.
    """
    low = fold_ascii(data)
    starts, ends, doc = words(low, offsets)
    n_docs = len(offsets) - 1
    per_doc = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(per_doc)])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    word = segment_hashes(low, starts, ends)
    n = len(word)
    rolled = np.full(max(0, n - width + 1), width, np.uint64)
    for i in range(width):
        rolled = mix(rolled * _STEP + word[i : i + len(rolled)])
    parts, bounds = [], np.zeros(n_docs + 1, np.int64)
    for d in range(n_docs):
        a, b = first[d], first[d + 1]
        if b - a >= width:
            own = np.unique(rolled[a : b - width + 1])
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                short = mix(short * _STEP + word[i : i + 1])
            own = short
        else:
            own = rolled[:0]
        parts.append(own)
        bounds[d + 1] = bounds[d] + len(own)
    return np.concatenate(parts), bounds


def slide_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values (van Herk: two running minima per block of ``width``)."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    if width == 1:
        return values
    pad = -len(values) % width
    top = np.iinfo(values.dtype).max
    grid = np.concatenate([values, np.full(pad, top, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def closed_syncmers(hashes: np.ndarray, k: int, s: int) -> np.ndarray:
    """Starts of the k-mers whose least s-mer (leftmost of ties) is their first or their last.

    ``hashes`` has the s-mers' hashes by start.  Whether a k-mer is chosen depends on its
    own bytes alone, and of any k - s consecutive k-mers at least one is chosen.
    """
    span = k - s
    least = slide_min(hashes, span + 1)
    n = len(least)
    if not n:
        return np.zeros(0, np.int64)
    at_start = hashes[:n] == least
    # the last s-mer is the leftmost minimum only if no earlier one ties with it
    before = slide_min(hashes[: n + span - 1], span) if span else hashes[:n]
    at_end = (hashes[span : span + n] == least) & (before[:n] > least) if span else at_start
    return np.flatnonzero(at_start | at_end)
