"""License scans by a positional index of rare words.

Every template (a base phrase, or a passage of a licence) is indexed by its rarest words, by document frequency over the whole
table. A file's words are looked up in that index only; each hit proposes where the template would start, and proposals of
several words are intersected by their relative position. A base phrase must then stand there word for word. A passage must
have its mandatory key phrase there and a share of its words, weighted by their rarity, at their places.

Words are runs of digits, letters a-z and characters beyond ASCII, after A-Z are lowered.

Defined results: a null or empty text has no words, no labels and score 0. Repeated rows are scanned alike. An empty table
gives no rows. Texts of any length are scanned whole, and every place of a base phrase counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import column, keyed, slices
from wordloom.llm.hashing import Powers, joined, word_hashes, word_spans

# Phrases and labels that must be reported as they are.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Label, passage, and the key phrase in it without which it does not count.
PASSAGES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("cc", "licensed under a creative commons attribution license", "creative commons"),
    ("cc", "licensed under cc by", "licensed under cc by"),
)

#: Rarest words of a passage that are looked up, votes that a proposal needs, and weighted share of words in place.
RARE, VOTES, SHARE = 6, 2, 0.6

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Template:
    label: str
    words: list[str]
    #: First word and number of words of the key phrase.
    key: tuple[int, int]
    base: bool


def templates() -> list[Template]:
    out = [Template(label, phrase.split(), (0, len(phrase.split())), True) for phrase, label in BASE]
    for label, passage, key in PASSAGES:
        words, wanted = passage.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(wanted)] == wanted)
        out.append(Template(label, words, (at, len(wanted)), False))
    return out


class Reader:
    """The words of texts, and which words of a vocabulary they are (-1: none)."""

    def __init__(self, vocabulary: list[str]):
        self.powers = Powers()
        data, offsets = joined([w.encode() for w in vocabulary])
        hashes = word_hashes(data, offsets[:-1], offsets[1:] - 1, self.powers)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.texts = [w.encode() for w in vocabulary]

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number in the vocabulary of each word, and the index of each text's first word."""
        data, offsets = joined(texts)
        data = LOWER[data]
        starts, ends = word_spans(data, IS_WORD)
        hashes = word_hashes(data, starts, ends, self.powers)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = np.flatnonzero(self.hashes[at] == hashes)
        number = np.full(len(starts), -1, np.int64)
        number[found] = self.order[at[found]]
        # A hash proposes a word, its bytes decide.
        for i in found:
            if data[starts[i] : ends[i]].tobytes() != self.texts[number[i]]:
                number[i] = -1
        return number, np.searchsorted(starts, offsets)


def rarity(rows: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Inverse document frequency of the templates' words over all texts, and whether any text holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(vocabulary)
        counts, total = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            total += batch.num_rows
            for texts in slices(column(batch, "text")):
                number, first = reader.read(texts)
                at = np.flatnonzero(number >= 0)
                owner = np.searchsorted(first, at, "right") - 1
                pairs = np.unique(owner * len(vocabulary) + number[at])
                counts += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(vocabulary))), pa.array(np.concatenate([[total], counts]))], names=["word", "n"])

    found = rows.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in found}
    total = counts.get(-1, 0)
    held = np.array([counts.get(i, 0) for i in range(len(vocabulary))], np.int64)
    return np.array([math.log((1 + total) / (1 + n)) + 1e-3 for n in held.tolist()]), held > 0


class Index:
    """Postings of the templates' rare words.

    Words that no text holds are no use as postings, so the rarest of the others stand for a template, and one of its key phrase is
    always among them.
    """

    def __init__(self, vocabulary: list[str], idf: np.ndarray, held: np.ndarray):
        self.reader = Reader(vocabulary)
        place = {w: i for i, w in enumerate(vocabulary)}
        self.templates = templates()
        self.numbers = [np.array([place[w] for w in t.words], np.int64) for t in self.templates]
        self.weights = [idf[n] for n in self.numbers]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        self.votes = []
        for i, (t, number) in enumerate(zip(self.templates, self.numbers)):
            key, size = t.key
            rarest = sorted({w for w in number.tolist() if held[w]}, key=lambda w: (-idf[w], w))
            mandatory = [w for w in rarest if w in number[key : key + size]][:1]
            ranked = [*mandatory, *(w for w in rarest if w not in mandatory)][: 1 if t.base else RARE]
            self.votes.append(max(1, min(1 if t.base else VOTES, len(ranked))))
            for at, w in enumerate(number.tolist()):
                if w in ranked:
                    self.postings.setdefault(w, []).append((i, at))
        self.rare = np.zeros(len(vocabulary) + 1, bool)
        self.rare[list(self.postings)] = True

    def scan(self, number: np.ndarray) -> tuple[list[tuple[int, int]], dict[str, float]]:
        """(start, length) and label of every place of a base phrase, and the score of every label found."""
        votes: dict[tuple[int, int], int] = {}
        for pos in np.flatnonzero(self.rare[number]).tolist():
            for i, at in self.postings[int(number[pos])]:
                votes[i, pos - at] = votes.get((i, pos - at), 0) + 1
        places, labels = [], {}
        for (i, start), n in votes.items():
            if n < self.votes[i]:
                continue
            t, wanted = self.templates[i], self.numbers[i]
            low, high = max(0, start), min(len(number), start + len(wanted))
            same = np.zeros(len(wanted), bool)
            same[low - start : high - start] = number[low:high] == wanted[low - start : high - start]
            key, size = t.key
            if not same[key : key + size].all():
                continue
            score = float(self.weights[i][same].sum() / self.weights[i].sum())
            if score >= SHARE:
                labels[t.label] = max(labels.get(t.label, 0.0), min(1.0, score))
                if t.base:
                    places.append((start, t.label))
        return places, labels


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: row_key, id, n_words, places (start and label of base phrases), labels, scores (as labels)."""
    rows = keyed(docs, id_col, {"text": text_col})
    vocabulary = sorted({w for t in templates() for w in t.words})
    idf, held = rarity(rows, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(vocabulary, idf, held)
        place = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
        for batch in batches:
            n_words, places, labels, scores = [], [], [], []
            for texts in slices(column(batch, "text")):
                number, first = index.reader.read(texts)
                for low, high in zip(first[:-1], first[1:]):
                    n_words.append(int(high - low))
                    found, named = index.scan(number[low:high])
                    places.append([{"start": s, "label": x} for s, x in sorted(found)])
                    labels.append(sorted(named))
                    scores.append([named[x] for x in sorted(named)])
            made = [pa.array(n_words, pa.int64()), pa.array(places, place), pa.array(labels, pa.list_(pa.string())), pa.array(scores, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("row_key", "id")), *made], names=["row_key", "id", "n_words", "places", "labels", "scores"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"row_key long, id {kind}, n_words long, places array<struct<start:bigint,label:string>>, labels array<string>, scores array<double>")
