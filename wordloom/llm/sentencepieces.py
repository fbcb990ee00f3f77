"""SentencePiece encoding and decoding for merge-type vocabularies: a score-ordered agenda of adjacent symbol pairs.

A text is normalised as the model says (a space before it, every space written as U+2581) and cut where a run of U+2581 follows
another character. No piece of the vocabulary holds such a place, so no merge crosses it and the words between the cuts can be
merged by themselves. A word starts as its characters; all neighbouring pairs whose join is a piece stand on its agenda, ordered by
score, then from left to right. The best pair is merged, and the pairs with its new neighbours take their places on the agenda.
Characters outside the vocabulary become byte pieces. Every Arrow batch merges the words that it has not met before, side by side,
and holds them against the library, which has to give the same ids; decoding joins the pieces' bytes, and is held against the
library's text for text.

Models are read that merge pairs, fall back to bytes, do not rewrite characters and have no user-defined or unused pieces; others
are refused when a job is built.

Defined results: a null or empty text has the begin and end ids alone and decodes to an empty text; white space is kept as it
stands, and U+2581 in a text comes back as a space, as with the library. Repeated rows are encoded each; very long texts and words
are merged whole.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from wordloom.llm.common import column, keyed, stretches
from wordloom.llm.merging import BITS, LONG, Memory, Merger, in_bytes, laid_out

#: How the format writes a space.
SPACE = "▁"
#: Bytes of words and ids that a task remembers; half of them at least stay when it makes room.
CACHE_BYTES = 64 << 20
#: Texts are encoded about so many bytes at a time.
SLICE = 1 << 22

# Fixed values of the model format: field numbers, kinds of pieces, and the number of the merge-type model.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, BEGIN_ID, END_ID = 3, 35, 41, 42
CHARACTER_MAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_TYPE = 2


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(message):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, message[at : at + size]
        at += size


@dataclass(frozen=True)
class Vocabulary:
    """What a model file says, as far as encoding and decoding need it."""

    cost: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int]
    raw: list[bytes]
    begin: int
    end: int


def read_vocabulary(model: bytes) -> Vocabulary:
    """The vocabulary of a serialized model; a model that is not of the kind described above is refused."""
    cost, ids, byte_ids, raw = {}, {}, [0] * 256, []
    trainer, normalizer = {}, {}
    for number, value in fields(model):
        if number == TRAINER:
            trainer = dict(fields(value))
        elif number == NORMALIZER:
            normalizer = dict(fields(value))
        elif number == PIECES:
            entry = dict(fields(value))
            text, kind = entry[PIECE_TEXT].decode(), entry.get(PIECE_KIND, NORMAL)
            if kind == NORMAL:
                ids[text] = len(raw)
                cost[text] = -float(np.frombuffer(entry[PIECE_SCORE], "<f4")[0])
                raw.append(text.replace(SPACE, " ").encode())
            elif kind == BYTE:
                byte_ids[int(text[1:-1], 16)] = len(raw)
                raw.append(bytes([int(text[1:-1], 16)]))
            elif kind in (CONTROL, UNKNOWN):
                raw.append(b"" if kind == CONTROL else " ⁇ ".encode())
            else:
                raise ValueError(f"user-defined and unused pieces are not supported: {text!r}")
    if trainer.get(MODEL_TYPE) != MERGE_TYPE or not trainer.get(BYTE_FALLBACK):
        raise ValueError("the model does not merge pairs with a fallback to bytes")
    if normalizer.get(CHARACTER_MAP) or normalizer.get(EXTRA_SPACES, 1) or not (normalizer.get(DUMMY_PREFIX, 1) and normalizer.get(ESCAPE_SPACES, 1)):
        raise ValueError("the model rewrites characters or spaces")
    if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in cost):
        raise ValueError("a piece of the model has a space after another character")
    return Vocabulary(cost, ids, byte_ids, raw, trainer.get(BEGIN_ID, 1), trainer.get(END_ID, 2))


def merge_long(word: str, cost: dict[str, float]) -> list[str]:
    """The symbols of a word of any length; its agenda is a heap, in which entries grow stale as symbols change."""
    n = len(word)
    stop = list(range(1, n + 1))  # where the symbol that starts here ends; 0 once it is part of another
    before = list(range(-1, n - 1))  # where the symbol before this one starts
    agenda = [(cost[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in cost]
    heapify(agenda)
    while agenda:
        _, left, end = heappop(agenda)
        right = stop[left]
        if not right or right >= n or stop[right] != end:
            continue
        stop[left], stop[right] = end, 0
        if end < n:
            before[end] = left
            joined = word[left : stop[end]]
            if joined in cost:
                heappush(agenda, (cost[joined], left, stop[end]))
        first = before[left]
        if first >= 0:
            joined = word[first:end]
            if joined in cost:
                heappush(agenda, (cost[joined], first, end))
    out, at = [], 0
    while at < n:
        out.append(word[at : stop[at]])
        at = stop[at]
    return out


class Agenda:
    """Merges many words at once; words of more than ``LONG`` characters one by one, with a heap."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.size = vocabulary, len(vocabulary.raw)
        #: The symbol of each character: its id, or a number beyond all ids.
        self.symbols = np.arange(0x110000, dtype=np.int64) + self.size
        for text, i in vocabulary.ids.items():
            if len(text) == 1:
                self.symbols[ord(text)] = i

        def symbol(text: str) -> int | None:
            return int(self.symbols[ord(text)]) if len(text) == 1 else vocabulary.ids.get(text)

        pairs, costs = {}, np.zeros(self.size)
        for text, i in vocabulary.ids.items():
            costs[i] = vocabulary.cost[text]
            for at in range(1, len(text)):
                left, right = symbol(text[:at]), symbol(text[at:])
                if left is not None and right is not None:
                    pairs[left << BITS | right] = i
        # Equal scores stay equal, for then the place decides.
        self.merger = Merger(pairs, np.unique(costs, return_inverse=True)[1])

    def merge(self, words: list[str]) -> list[list[int]]:
        """The ids of normalised words."""
        size = np.array([len(w) for w in words], np.int64)
        out = self.merger.merge(self.symbols[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)], size)
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = [self.vocabulary.ids.get(s, self.size + ord(s[0])) for s in merge_long(words[i], self.vocabulary.cost)]
        for i, ids in enumerate(out):
            if ids and max(ids) >= self.size:  # characters outside the vocabulary
                out[i] = [x for s in ids for x in ([s] if s < self.size else self.in_bytes(chr(s - self.size)))]
        return out

    def in_bytes(self, character: str) -> list[int]:
        return [self.vocabulary.byte_ids[b] for b in character.encode()]


class Encoder:
    """From texts to their ids as little-endian unsigned 32-bit numbers, begin and end ids included.

    Words are written without their first U+2581. The different words of a call are looked up; those met for the first time are
    merged together, and checked by the library, all of them at once. When ``cache_bytes`` are used, the older half of the words is
    let go, but for those that are asked for again meanwhile.
    """

    def __init__(self, model: bytes, cache_bytes: int = CACHE_BYTES):
        self.vocabulary = read_vocabulary(model)
        self.agenda = Agenda(self.vocabulary)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.memory = Memory(self.learn, cache_bytes)

    def learn(self, words: list[str]) -> list[bytes]:
        found = self.agenda.merge([SPACE + w for w in words])
        checked = [i for i, w in enumerate(words) if w]  # the library has no ids for an empty text
        if self.library.encode([words[i] for i in checked], num_threads=1) != [found[i] for i in checked]:
            raise RuntimeError("the agenda and the library differ")
        return in_bytes(found)

    def encode(self, texts: pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(texts, " ")
        sizes = np.where(pc.equal(texts, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(split).to_numpy(zero_copy_only=False))
        odd = pc.or_(pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, "  ")), pc.match_substring(texts, SPACE))
        if pc.any(pc.or_(odd, pc.equal(texts, ""))).as_py():
            # Runs of spaces and U+2581 stay together: these texts are split one by one.
            lists = [words_of(t) if o or not t else None for t, o in zip(texts.to_pylist(), odd.to_pylist())]
            plain = split.to_pylist()
            lists = [p if w is None else w for p, w in zip(plain, lists)]
            sizes = np.array([len(w) for w in lists], np.int64)
            words = pa.array([w for one in lists for w in one], pa.string())
        else:
            words = split.flatten()
        encoded, ends = laid_out(words, self.memory.ids_of)
        borders = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.vocabulary.begin, self.vocabulary.end))
        return [begin + encoded[a:b].tobytes() + end for a, b in zip(borders, borders[1:])]


def words_of(text: str) -> list[str]:
    """The words of any text, without their first U+2581."""
    return [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))] if text else []


def one_mark_a_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


class Decoder:
    """From ids to texts: the pieces' bytes in order, less the space before the text."""

    def __init__(self, model: bytes):
        vocabulary = read_vocabulary(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = np.frombuffer(b"".join(vocabulary.raw), np.uint8)
        self.size = np.array([len(r) for r in vocabulary.raw], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.spaced = np.zeros(len(vocabulary.raw), bool)
        self.spaced[[i for text, i in vocabulary.ids.items() if text[0] == SPACE]] = True
        codecs.register_error("one_mark_a_byte", one_mark_a_byte)

    def decode(self, encoded: bytes) -> str:
        ids = np.frombuffer(encoded, "<u4").astype(np.int64)
        size = self.size[ids]
        ends = np.cumsum(size)
        joined = self.bytes[np.repeat(self.first[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        shown = np.flatnonzero(size)
        skip = int(len(shown) and self.spaced[ids[shown[0]]])
        # Bytes on both sides of a control piece make no character together.
        borders = sorted({skip, len(joined), *(int(e) for e in ends[size == 0] if e > skip)})
        text = "".join([joined[a:b].decode("utf-8", "one_mark_a_byte") for a, b in zip(borders, borders[1:])])
        if self.library.decode(ids.tolist()) != text:
            raise RuntimeError("decoding and the library differ")
        return text


def encode(docs: DataFrame, model: bytes, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: row_key, id, ids (binary: little-endian unsigned 32-bit numbers). ``model`` is the serialized model."""
    read_vocabulary(model)
    rows = keyed(docs, id_col, {"text": text_col})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for start, stop in stretches(sizes, SLICE):
                ids = encoder.encode(texts.slice(start, stop - start))
                keys = [batch.column(batch.schema.get_field_index(c)).slice(start, stop - start) for c in ("row_key", "id")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(ids, pa.binary())], names=["row_key", "id", "ids"])

    return rows.select("row_key", "id", "text").mapInArrow(run, f"row_key long, id {dict(rows.dtypes)['id']}, ids binary")


def decode(encoded: DataFrame, model: bytes, ids_col: str = "ids") -> DataFrame:
    """The table with the texts of its ``ids`` added as ``decoded``. Null ids have a null text."""
    names = [n for n in encoded.columns if n != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in batches:
            texts = pa.array([None if x is None else decoder.decode(x) for x in column(batch, ids_col)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), texts], names=[*names, "decoded"])

    kinds = dict(encoded.dtypes)
    return encoded.select(*[f"`{n}`" for n in names]).mapInArrow(run, ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "decoded string"]))
