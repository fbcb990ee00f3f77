"""Repeated passages: of words (De Bruijn) and of bytes (suffix sort)."""

import random

import numpy as np
import pytest

from tests.llm.helpers import SCHEMA, covered_words, prose, rows, words
from wordloom.llm import debruijn, suffixes


def odd_texts(seed):
    rng = random.Random(seed)
    base = [prose(rng, 150) for _ in range(4)]
    texts = [None, "", " \n\t ", "one two", base[0], base[0]]
    texts += [base[1] + " " + prose(rng, 40), prose(rng, 30) + " " + base[1]]
    # Windows that only just fit, branch, and overlap themselves.
    texts += [" ".join(base[2].split()[20:55]), prose(rng, 10) + " " + " ".join(base[2].split()[10:80]) + " " + prose(rng, 9), base[2]]
    texts += ["a b c " * 60, "x " * 90, "x " * 35, "x " * 36, base[3].replace(" ", "\n"), "é ü " * 50 + base[3]]
    for _ in range(12):
        source = rng.choice(base).split()
        at, n = rng.randrange(100), rng.randrange(20, 50)
        texts.append(prose(rng, rng.randrange(40)) + " " + " ".join(source[at : at + n]) + " " + prose(rng, rng.randrange(40)))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_words_against_brute_force(spark, seed):
    texts = odd_texts(seed)
    found = debruijn.remove_repeats(spark.createDataFrame(rows(texts), SCHEMA)).orderBy("id").collect()
    for row, text, cover in zip(found, texts, covered_words(texts, debruijn.WINDOW), strict=True):
        kept = " ".join(w for w, c in zip(words(text), cover) if not c)
        assert (row["n_words"], row["n_removed"], row["kept"]) == (len(cover), sum(cover), kept), text


def test_words_of_odd_ids_and_no_rows(spark):
    text = prose(random.Random(5), 40)
    found = debruijn.remove_repeats(spark.createDataFrame(rows([text, text, "a b"], [None, None, 3]), SCHEMA)).collect()
    assert sorted((r["id"] or 0, r["n_removed"]) for r in found) == [(0, 40), (0, 40), (3, 0)]
    assert debruijn.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_bytes(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - window + 1):
            seen[d[i : i + window]] = seen.get(d[i : i + window], 0) + 1
    out = []
    for d in data:
        cover = np.zeros(len(d), bool)
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                cover[i : i + window] = True
        out.append((len(d), int(cover.sum()), bytes(np.frombuffer(d, np.uint8)[~cover])))
    return out


@pytest.mark.parametrize("crowd", [4096, 1])
def test_bytes_against_brute_force(spark, crowd):
    texts = odd_texts(3)
    rng = random.Random(9)
    shared = prose(rng, 30)
    # One passage in many surroundings: every neighbourhood is a class of its own.
    texts += [prose(rng, 8) + " " + shared + " " + prose(rng, 8) for _ in range(12)]
    table = spark.createDataFrame(rows(texts), SCHEMA)
    found = suffixes.remove_repeats(table, window=40, gram=24, crowd=crowd).orderBy("id").collect()
    assert [(r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in found] == brute_bytes(texts, 40)
    for r in found:
        runs = list(zip(r["removed"][::2], r["removed"][1::2]))
        assert sum(b - a for a, b in runs) == r["n_removed"] and all(x[1] < y[0] for x, y in zip(runs, runs[1:]))


def test_bytes_production_window(spark):
    texts = odd_texts(4)
    table = spark.createDataFrame(rows(texts), SCHEMA)
    found = suffixes.remove_repeats(table).orderBy("id").collect()
    assert [(r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in found] == brute_bytes(texts, suffixes.WINDOW)
    assert suffixes.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    places = np.arange(0, 380)
    group = np.repeat([0, 1, 2], [200, 1, 179])
    comparer = suffixes.Comparer(data, 16, suffixes.Powers())
    done = suffixes.merge_sort(places, group, comparer)
    for g in range(3):
        mine = done[group == g]
        assert [data[p : p + 16].tobytes() for p in mine] == sorted(data[p : p + 16].tobytes() for p in places[group == g])


def test_long_text_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 300)
    texts = [prose(random.Random(1), 400), prose(random.Random(2), 50) + " " + prose(random.Random(1), 400)]
    parts = [x for some in suffixes.blocks(texts, 40) for x in some]
    assert {x[0] for x in parts} == {0, 1} and all(len(x[2]) <= 339 for x in parts)
    for i, text in enumerate(texts):
        joined = b"".join(x[2][:300] if j < sum(p[0] == i for p in parts) - 1 else x[2] for j, x in enumerate(p for p in parts if p[0] == i))
        assert joined == text.encode()
