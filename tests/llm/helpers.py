"""Documents with everything that may be odd, and brute-force versions of what the operators promise."""

from __future__ import annotations

import random
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, row_key string, id string, kept string, counts int"


def words(text):
    return WORD.findall(text or "")


def rows(texts, ids=None):
    """Documents with columns whose names the operators use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    return [(i, t, "en", "s", "x", "y", "z", 7) for i, t in zip(ids, texts)]


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def near_copy(rng: random.Random, text: str, edits: int) -> str:
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def covered_words(texts, window):
    """For each text, which words a window covers that starts anywhere else too."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        cover = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                cover[i : i + window] = [True] * window
        out.append(cover)
    return out


def classes(n, links):
    """The smallest member of each member's component."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingle_counts(text, size=5):
    w = words(text)
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def weighted_jaccard(a, b):
    common = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 0.0
