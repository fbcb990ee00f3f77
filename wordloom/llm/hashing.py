"""Rolling hashes, words and minimizers of many texts at once, in numpy.

A hash of the items i..j of a sequence is ``sum(code[x] * BASE**x)`` over them, divided by ``BASE**i``, in 64-bit arithmetic:
two prefix sums give it for any i and j (the base is odd, so it has an inverse).
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
#: Two independent hashes: bases (odd numbers) and seeds.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of MurmurHash3: spreads all bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Powers:
    """Powers of a base and of its inverse, made as they are needed, and a random code for every byte."""

    def __init__(self, which: int = 0):
        self.base = BASES[which]
        self.inverse = pow(self.base, -1, 1 << 64)
        self.codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93 + 2 * which))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            steps = np.full(size, self.base, np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps)
            steps[1:] = self.inverse
            self.down = np.cumprod(steps)
        return self.up[:n], self.down[:n]

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        """Prefix sums, one longer than the sequence."""
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.upto(len(codes))[0], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the ranges from ``start`` to before ``end``, which do not depend on where they stand."""
        return (prefix[end] - prefix[start]) * self.upto(len(prefix))[1][start]

    def windows(self, prefix: np.ndarray, size: int) -> np.ndarray:
        n = len(prefix) - size
        return (prefix[size:] - prefix[:n]) * self.upto(len(prefix))[1][:n] if n > 0 else np.zeros(0, np.uint64)


def joined(texts: list[bytes], separator: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """The texts in one array with a separator after each, and the offset of each (one more at the end)."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + len(separator)
    return np.frombuffer(separator.join([*texts, b""]), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


#: Bytes that are no white space: all but space and 09 to 0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def word_spans(data: np.ndarray, is_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes."""
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = is_word[data]
    steps = np.diff(flags)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each word, by blocks of bounded size (a word longer than a block makes a longer one)."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        prefix = powers.prefix(powers.codes[data[low : ends[to - 1]]])
        out[at:to] = powers.ranges(prefix, starts[at:to] - low, ends[at:to] - low)
        at = to
    return mix(out ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def words_of(texts: list[bytes], powers: Powers, is_word: np.ndarray = NOT_SPACE):
    """Hash of every word of the texts, and the index of each text's first word (one more at the end)."""
    data, offsets = joined(texts)
    starts, ends = word_spans(data, is_word)
    return word_hashes(data, starts, ends, powers), np.searchsorted(starts, offsets), (data, starts, ends)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive items, over the borders of texts too."""
    size = max(0, len(words) - n + 1)
    out = words[:size].copy()
    for j in range(1, n):
        out *= np.uint64(BASES[1])
        out += words[j : j + size]
    return mix(out)


def minimizers(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest of each ``width`` consecutive values, the leftmost on a tie (of the upper 40 bits).

    The minimum of a window is that of a suffix of one stretch of ``width`` values and of a prefix of the next. Long
    sequences are worked on in blocks.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    for low in range(0, n, BLOCK):
        part = values[low : min(low + BLOCK, n) + width - 1]
        size = -(-len(part) // width) * width
        held = np.full(size, MASK, np.uint64)
        held[: len(part)] = (part & np.uint64(MASK ^ 0xFFFFFF)) | np.arange(len(part), dtype=np.uint64)
        grid = held.reshape(-1, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        m = len(part) - width + 1
        least = np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])
        out[low : low + m] = (least & np.uint64(0xFFFFFF)).astype(np.int64) + low
    return out


def runs(values: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position in ``index`` of each run of neighbouring indexes with one value."""
    if not len(index):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero((np.diff(index) != 1) | (np.diff(values) != 0)) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(index) - 1]])


def in_text(first: np.ndarray, size: int) -> np.ndarray:
    """Indexes at which ``size`` items of one text stand, ``first`` being the texts' first items (and the end)."""
    n = np.maximum(0, np.diff(first) - size + 1)
    total = int(n.sum())
    return np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
