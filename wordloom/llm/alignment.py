"""Alignment of two tokenizers over the same bytes, with a fast path for tokens that both have.

A text with a space before it is cut before every space that follows a character other than white space; both tokenizers have a
border there, so the pieces (mostly a space and a word) are tokenized by themselves, each new one once, and many in one call. Byte
offsets where tokens of both sides end cut a piece into groups. Before any text is read, an array gives for every A id the B id of
the same bytes: a group of just these two is regular. Regular links are counted in vectors as long as A's vocabulary. Only the
other pairs, from groups of several tokens, go into a shuffle, as ids and their number per document. How many documents hold each of
those pairs is a grouped count; the highest count of an A id is the larger of its vector entry and its largest pair count.

What the driver holds are vectors of A's vocabulary. Pair counts are broadcast when they are measured to be small; beyond that, the
join deals hot pairs out over many tasks.

Defined results: a null or empty text, and one whose tokens do not give back its bytes (a literal U+2581, which the second tokenizer
reads as a space), has no tokens: all numbers are 0 and the digest is empty. Special tokens' strings are plain text. Repeated rows count
each; ties for the highest count are all best. Groups of any size are counted by distinct ids, so a long text without common
borders costs no more than its distinct pairs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordloom.llm.common import column, join_rows, keyed, stretches
from wordloom.llm.sentencepieces import SPACE, read_vocabulary
from wordloom.operators.joins import lookup
from wordloom.sources.scratch import materialise

#: A pair of ids as one number.
SHIFT = 32
#: Bytes of pieces that a task remembers; half of them at least stay when it makes room.
CACHE_BYTES = 96 << 20
#: What a remembered piece takes besides its own bytes.
ENTRY_BYTES = 360
#: Texts are worked on about so many characters at a time; new pieces are tokenized so many at a time.
SLICE, CALL = 1 << 21, 512
#: Groups of so many pairs are counted pair by pair, larger ones by distinct ids.
FEW = 64
CUT = re.compile(r"(?<=\S)(?= )")
#: Where a plain split at spaces would not cut as ``CUT`` does.
ODD = re.compile(r"\s ")


def byte_characters() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself where it is printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def bytes_of_a(tokenizer: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; special tokens have none of their own."""
    model, known = json.loads(tokenizer)["model"], byte_characters()
    out = [b""] * (max(model["vocab"].values()) + 1)
    for text, i in model["vocab"].items():
        if all(c in known for c in text):
            out[i] = bytes(known[c] for c in text)
    return out


def identity_map(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The B id with the same bytes for every A id, the smallest of several, or -1."""
    found: dict[bytes, int] = {}
    for i, raw in enumerate(b):
        if raw:
            found.setdefault(raw, i)
    return np.array([found.get(raw, -1) if raw else -1 for raw in a], np.int64)


class Aligner:
    """From pieces to their numbers, groups and links; each distinct piece is tokenized and aligned once while it is remembered."""

    def __init__(self, tokenizer_a: str, model_b: bytes, cache_bytes: int = CACHE_BYTES):
        self.a = Tokenizer.from_str(tokenizer_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        raw_a, vocabulary = bytes_of_a(tokenizer_a), read_vocabulary(model_b)
        self.size_a, self.size_b = (np.array(list(map(len, raw)), np.int64) for raw in (raw_a, vocabulary.raw))
        self.alone = vocabulary.ids.get(SPACE)
        self.names = list(map(str, range(max(len(raw_a), len(vocabulary.raw)))))
        self.room, self.used = cache_bytes // 2, 0
        #: A piece without its first space: (n_a, n_b, n_groups, n_links) and (pair, n) as bytes, and the groups' text.
        self.known: dict[str, tuple[bytes, bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes, bytes]] = {}

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The pieces of a space and the text, without their first space."""
        if text[0] != " " and not ODD.search(text):
            return text.split(" ")
        return [p[1:] for p in CUT.split(" " + text)]

    def learn(self, pieces: list[str]) -> None:
        """Tokenize pieces that end in no white space in one call: put together, they are cut where they were."""
        plain = [p for p in pieces if p and not p[-1].isspace()]
        for at in range(0, len(plain), CALL):
            self.align(plain[at : at + CALL])
        for p in pieces:
            if not p or p[-1].isspace():
                self.align([p])

    def align(self, pieces: list[str]) -> None:
        text = " ".join(pieces)
        a = np.array(self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self.b.encode(text) if text else [self.alone], np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.cumsum([len(p.encode()) + 1 for p in pieces])
        if not ends_a[-1] == ends_b[-1] == ends[-1]:
            raise RuntimeError("tokens do not give back their text")
        borders = ends_a[ends_b[np.searchsorted(ends_b, ends_a)] == ends_a]
        group_a, group_b = np.searchsorted(borders, ends_a), np.searchsorted(borders, ends_b)
        # The piece of every group, and how many tokens a group has on either side.
        owner = np.searchsorted(ends, borders)
        n_a, n_b = np.bincount(group_a), np.bincount(group_b)
        n = len(pieces)
        links = np.bincount(owner, (n_a * n_b).astype(np.float64), n).astype(np.int64)
        counts = [np.bincount(owner[g], minlength=n) for g in (group_a, group_b)] + [np.bincount(owner, minlength=n), links]
        numbers = np.stack(counts, axis=1).astype(np.int64).tobytes()
        texts = self.group_texts(a, b, group_a, group_b, owner)
        codes, times, of = self.group_pairs(a, b, group_a, group_b, n_a, n_b, owner)
        raw = np.stack([codes, times], axis=1).tobytes()
        stops = (16 * np.cumsum(np.bincount(of, minlength=n))).tolist()
        for i, (piece, start, stop, groups) in enumerate(zip(pieces, [0, *stops], stops, texts)):
            self.known[piece] = numbers[32 * i : 32 * i + 32], raw[start:stop], groups
        self.used += ENTRY_BYTES * n + len(raw) + 2 * len(text) + sum(map(len, texts))

    def group_texts(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, owner: np.ndarray) -> list[bytes]:
        """The groups of each piece as text: the tokens of both sides in the order of groups, and a mark after each."""
        side = np.concatenate([2 * group_a, 2 * group_b + 1])
        order = np.argsort(side, kind="stable")
        side = side[order]
        names = list(map(self.names.__getitem__, np.concatenate([a, b])[order].tolist()))
        after = np.zeros(len(side), np.int64)
        after[:-1] = np.where(side[1:] == side[:-1], 0, np.where(side[1:] >> 1 == side[:-1] >> 1, 1, 2))
        after[:-1][owner[side[1:] >> 1] != owner[side[:-1] >> 1]] = 3
        marks = list(map((",", "|", ";", "\n").__getitem__, after[:-1].tolist()))
        return "".join(chain.from_iterable(zip(names, [*marks, ""]))).encode().split(b"\n")

    @staticmethod
    def group_pairs(
        a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, owner: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of ids, their numbers, and their pieces, in the order of pieces; a pair may come more than once."""
        few = n_a * n_b <= FEW
        first_b = np.cumsum(n_b) - n_b
        width = np.where(few, n_b, 0)[group_a]
        ends = np.cumsum(width)
        left = np.repeat(np.arange(len(a)), width)
        right = np.arange(ends[-1]) - np.repeat(ends - width, width) + first_b[group_a[left]]
        codes, times, of = a[left] << SHIFT | b[right], np.ones(len(left), np.int64), owner[group_a[left]]
        if few.all():
            return codes, times, of
        first_a, more = np.cumsum(n_a) - n_a, []
        for g in np.flatnonzero(~few).tolist():  # large groups, by their distinct ids
            counted = Counter(b[first_b[g] : first_b[g] + n_b[g]].tolist()).items()
            for x, n in Counter(a[first_a[g] : first_a[g] + n_a[g]].tolist()).items():
                more += [(x << SHIFT | y, n * m, owner[g]) for y, m in counted]
        codes, times, of = (np.concatenate([x, np.array(y, np.int64)]) for x, y in zip((codes, times, of), zip(*more)))
        order = np.argsort(of, kind="stable")
        return codes[order], times[order], of[order]

    def of(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, bytes] | None]:
        """For each text: n_a, n_b, n_groups, n_links; its distinct pairs and their numbers; its groups. None: no tokens."""
        if self.used > self.room:
            self.known, self.older, self.used = {}, self.known, 0
        split = [self.pieces(t) if t and SPACE not in t else [] for t in texts]
        coded = pc.dictionary_encode(pa.array(chain.from_iterable(split), pa.string()))
        different = coded.dictionary.to_pylist()
        missing = [p for p in different if p not in self.known]
        for p in missing:
            if p in self.older:
                self.known[p] = found = self.older[p]
                self.used += ENTRY_BYTES + len(p) + len(found[1]) + len(found[2])
        self.learn([p for p in missing if p not in self.older])
        numbers, links, groups = zip(*map(self.known.__getitem__, different)) if different else [()] * 3
        numbers = np.frombuffer(b"".join(numbers), np.int64).reshape(-1, 4)
        pairs = np.frombuffer(b"".join(links), np.int64).reshape(-1, 2)
        size = np.array([len(x) // 16 for x in links], np.int64)
        first, which, at, out = np.cumsum(size) - size, coded.indices.to_numpy(), 0, []
        for pieces in split:
            if not pieces:
                out.append(None)
                continue
            own = which[at : at + len(pieces)]
            at += len(pieces)
            used, times = np.unique(own, return_counts=True)
            sizes = size[used]
            ends = np.cumsum(sizes)
            chosen = pairs[np.repeat(first[used] - ends + sizes, sizes) + np.arange(ends[-1])]
            distinct, place = np.unique(chosen[:, 0], return_inverse=True)
            order = np.argsort(place, kind="stable")
            begins = np.searchsorted(place[order], np.arange(len(distinct)))
            held = np.add.reduceat((chosen[:, 1] * np.repeat(times, sizes))[order], begins)
            whole = b";".join(map(groups.__getitem__, own.tolist()))
            out.append(((numbers[used] * times[:, None]).sum(axis=0), distinct, held, whole))
        return out


def linked(rows: DataFrame, tokenizer_a: str, model_b: bytes, with_groups: bool = False) -> DataFrame:
    """row_key, id, n_a, n_b, n_groups, n_links, groups_sha256; same_a and same_n (regular ids and how often they are linked);
    pair_a, pair_b, pair_n (the other pairs); groups, if asked for."""
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same_a", "same_n", "pair_a", "pair_b", "pair_n", "groups"]
    names = names if with_groups else names[:-1]
    same = identity_map(bytes_of_a(tokenizer_a), read_vocabulary(model_b).raw)

    def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays]), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, none = Aligner(tokenizer_a, model_b), np.zeros(0, np.int64)
        for batch in batches:
            texts = column(batch, "text")
            for start, stop in stretches([len(t or "") for t in texts], SLICE):
                numbers, digests, whole, parts = [], [], [], [[] for _ in range(5)]
                for found in aligner.of(texts[start:stop]):
                    if found is None:
                        found = np.zeros(4, np.int64), none, none, b""
                    of, distinct, times, groups = found
                    a, b = distinct >> SHIFT, distinct & ((1 << SHIFT) - 1)
                    regular = same[a] == b
                    for part, x in zip(parts, (a[regular], times[regular], a[~regular], b[~regular], times[~regular])):
                        part.append(x)
                    numbers.append(of)
                    digests.append(hashlib.sha256(groups).hexdigest() if groups else "")
                    whole.append(groups.decode())
                keys = [batch.column(batch.schema.get_field_index(c)).slice(start, stop - start) for c in ("row_key", "id")]
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
                columns = [*map(pa.array, np.array(numbers, np.int64).reshape(-1, 4).T), pa.array(digests), *map(lists, parts, kinds)]
                columns += [pa.array(whole)] if with_groups else []
                yield pa.RecordBatch.from_arrays([*keys, *columns], names=["row_key", "id", *names])

    kinds = ["long"] * 4 + ["string", "array<int>", "array<long>", "array<int>", "array<int>", "array<long>", "string"]
    schema = ", ".join([f"row_key long, id {dict(rows.dtypes)['id']}", *(f"{n} {k}" for n, k in zip(names, kinds))])
    return rows.select("row_key", "id", "text").mapInArrow(run, schema)


def flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """All numbers of a list column without nulls."""
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)


def regular_counts(found: DataFrame, size: int) -> np.ndarray:
    """How many texts hold the regular pair of each A id: a vector per task, and their sum."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = np.zeros(size, np.int64)
        for batch in batches:
            texts += np.bincount(flat(batch, "same_a"), minlength=size)
        held = np.flatnonzero(texts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(texts[held])], names=["a", "n"])

    out = np.zeros(size, np.int64)
    sums = found.select("same_a").mapInArrow(count, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    for a, n in sums.collect():  # one row per id of the vocabulary at most
        out[a] = n
    return out


def regular_sums(found: DataFrame, counts: np.ndarray, best: np.ndarray) -> DataFrame:
    """``found`` without its lists, with n_best and count_sum of its regular links."""
    names = [n for n in found.columns if n not in ("same_a", "same_n", "pair_a", "pair_b", "pair_n")]
    is_best = counts == best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, times = flat(batch, "same_a"), flat(batch, "same_n")
            sizes = np.array([len(x) for x in batch.column(batch.schema.get_field_index("same_a"))], np.int64)
            ends = np.cumsum(sizes)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * is_best[ids], times * counts[ids])]
            added = [pa.array(s[ends] - s[ends - sizes], pa.int64()) for s in sums]
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, *added], names=[*names, "n_best", "count_sum"])

    kinds = dict(found.dtypes)
    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), "n_best long, count_sum long"])
    return found.select(*names, "same_a", "same_n").mapInArrow(run, schema)


def align(
    docs: DataFrame, tokenizer_a: str, model_b: bytes, text_col: str = "text", id_col: str = "doc_id", with_groups: bool = False
) -> DataFrame:
    """One row per document: row_key, id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum (and groups, as text).

    ``tokenizer_a`` is the JSON of a byte-level tokenizer, ``model_b`` a serialized SentencePiece model.
    """
    rows = keyed(docs, id_col, {"text": text_col})
    found = materialise(linked(rows, tokenizer_a, model_b, with_groups), "aligned")
    counts = regular_counts(found, len(bytes_of_a(tokenizer_a)))
    zipped = F.explode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("p")
    pair = F.shiftleft(F.col("p.pair_a").cast("long"), SHIFT).bitwiseOR(F.col("p.pair_b").cast("long")).alias("pair")
    pairs = found.select("row_key", zipped).select("row_key", pair, F.col("p.pair_n").alias("times"))
    table = materialise(pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("texts")), "pair-counts")
    best = counts.copy()
    highest = table.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("texts").alias("n"))
    for a, n in highest.collect():  # one row per id of the vocabulary at most
        best[a] = max(best[a], n)
    ids = np.flatnonzero(best)
    bests = docs.sparkSession.createDataFrame([(int(a), int(best[a])) for a in ids], "a long, best long")
    rated = table.join(F.broadcast(bests), F.shiftright("pair", SHIFT) == F.col("a"))
    rated = materialise(rated.select("pair", "texts", (F.col("texts") == F.col("best")).alias("is_best")), "rated-pairs")
    sums = lookup(pairs, rated, "pair", "row_key").groupBy("row_key")
    sums = sums.agg(
        F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("texts")).alias("more_sum"),
    )
    own = regular_sums(found, counts, best)
    added = [(F.col(n) + F.coalesce(m, F.lit(0))).alias(n) for n, m in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    joined = join_rows(own, materialise(sums, "pair-sums"), "row_key")
    return joined.select(*[n for n in own.columns if n not in ("n_best", "count_sum")], *added)
