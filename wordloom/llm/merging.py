"""Merging neighbouring symbols of many words at once, cheapest pair first."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of more symbols are left to the caller.
LONG = 24
#: The cost of what cannot be merged.
NEVER = np.iinfo(np.int32).max
#: Symbols are numbers of so many bits.
BITS = 21
#: Words are merged together with others of about their length.
LENGTHS = (6, 9, 14, LONG)


class Merger:
    """A word is a row of symbols, and a row of its neighbours' costs is its agenda.

    In every round each row merges the first of its cheapest pairs, the agendas close up, and the two pairs beside each merged
    symbol are looked up anew. Rows without a pair that can be merged are done. ``pairs`` maps two symbols, as ``left << BITS |
    right``, to the symbol they make; ``cost`` has the cost of making each symbol, as a rank.
    """

    def __init__(self, pairs: dict[int, int], cost: np.ndarray):
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.cost = cost.astype(np.int32)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost and symbol of joined pairs; ``NEVER`` where they make none or one of them is missing (-1)."""
        key = left << BITS | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        made = self.made[at]
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.cost[made], NEVER), made

    def rows(self, symbols: np.ndarray) -> np.ndarray:
        """The merged symbols of rows that are filled up with -1."""
        out, number = symbols.copy(), np.arange(len(symbols))
        cost, made = self.look_up(symbols[:, :-1], symbols[:, 1:])
        while len(number):
            at = cost.argmin(axis=1)
            going = cost[np.arange(len(number)), at] < NEVER
            if not going.all():
                done = number[~going]
                out[done, : symbols.shape[1]] = symbols[~going]
                out[done, symbols.shape[1] :] = -1
                number, symbols, cost, made, at = (x[going] for x in (number, symbols, cost, made, at))
                if not len(number):
                    break
                width = int((symbols >= 0).sum(axis=1).max())
                symbols, cost, made = symbols[:, :width], cost[:, : width - 1], made[:, : width - 1]
            row = np.arange(len(number))
            merged = made[row, at]
            beyond = np.arange(symbols.shape[1] - 1) >= at[:, None]
            closed = np.where(beyond, symbols[:, 1:], symbols[:, :-1])
            closed[row, at] = merged
            symbols = np.concatenate([closed, np.full((len(row), 1), -1)], axis=1)
            shift, fill = beyond[:, :-1], np.full((len(row), 1), NEVER, np.int32)
            cost = np.concatenate([np.where(shift, cost[:, 1:], cost[:, :-1]), fill], axis=1)
            made = np.concatenate([np.where(shift, made[:, 1:], made[:, :-1]), fill], axis=1)
            cost[row, at], made[row, at] = self.look_up(merged, symbols[row, at + 1])
            first = np.flatnonzero(at)
            before = at[first] - 1
            cost[first, before], made[first, before] = self.look_up(symbols[first, before], merged[first])
        return out

    def merge(self, flat: np.ndarray, size: np.ndarray) -> list[list[int]]:
        """The merged symbols of each word, whose symbols stand one after the other in ``flat``; none for words beyond ``LONG``."""
        out: list[list[int]] = [[]] * len(size)
        start, last = np.cumsum(size) - size, 0
        for longest in LENGTHS:
            chosen = np.flatnonzero((size > last) & (size <= longest))
            last = longest
            if not len(chosen):
                continue
            width = max(2, int(size[chosen].max()))
            within = np.arange(width) < size[chosen][:, None]
            symbols = np.where(within, flat[np.minimum(start[chosen][:, None] + np.arange(width), len(flat) - 1)], -1)
            merged = self.rows(symbols)
            found, ends = merged[merged >= 0].tolist(), np.cumsum((merged >= 0).sum(axis=1)).tolist()
            for i, a, b in zip(chosen.tolist(), [0, *ends], ends):
                out[i] = found[a:b]
        return out


def laid_out(words: pa.Array, ids_of: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, one after the other, and where those of each word end; only the different words are looked up.

    ``ids_of`` gives the ids of different words, as little-endian 32-bit numbers.
    """
    coded = pc.dictionary_encode(words)
    ids = ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    size = np.array([len(i) // 4 for i in ids], np.int64)
    which = coded.indices.to_numpy()
    own = size[which]
    ends = np.cumsum(own)
    places = np.repeat((np.cumsum(size) - size)[which] - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)
    return np.frombuffer(b"".join(ids), "<u4")[places], ends


class Memory:
    """Ids by word, within about ``limit`` bytes: when half of them are used, words that are not asked for again are let go."""

    #: What a remembered word takes besides its own bytes.
    ENTRY_BYTES = 200

    def __init__(self, learn: Callable[[list[str]], list[bytes]], limit: int):
        self.learn, self.room, self.used = learn, limit // 2, 0
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def add(self, words: list[str], ids: list[bytes]) -> None:
        self.known.update(zip(words, ids))
        self.used += sum(map(len, ids)) + sum(map(len, words)) + self.ENTRY_BYTES * len(words)

    def ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of different words; all that are new are learned together."""
        if self.used > self.room:
            self.known, self.older, self.used = {}, self.known, 0
        found = list(map(self.known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        kept = [i for i in missing if words[i] in self.older]
        new = [i for i in missing if words[i] not in self.older] if len(kept) < len(missing) else []
        fresh = self.learn([words[i] for i in new]) if new else []
        for which, some in ((kept, [self.older[words[i]] for i in kept]), (new, fresh)):
            self.add([words[i] for i in which], some)
            for i, ids in zip(which, some):
                found[i] = ids
        return found


def in_bytes(lists: list[list[int]]) -> list[bytes]:
    """Lists of ids as little-endian 32-bit numbers."""
    raw = np.array([i for one in lists for i in one], "<u4").tobytes()
    ends = np.cumsum([4 * len(one) for one in lists]).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]
