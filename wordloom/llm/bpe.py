"""Byte-level BPE: overlapping chunks are split into pre-tokens in parallel, stitched, then encoded piece by piece.

A text of up to ``CHUNK`` characters is one chunk. A longer one is dealt out as chunks that overlap by ``OVERLAP`` characters.
Every chunk is split into pre-tokens by itself; only those that end a few characters before the chunk's end are certain. Two
neighbouring chunks are stitched at the first position in their overlap where both start a pre-token: the pattern never looks
back, so from there on both split alike. A text in which two chunks share no such position (a run of letters longer than the
overlap) is split whole. Each stitched piece is then encoded, with a cache of pre-tokens; decoding concatenates the tokens'
bytes.

Defined results: a null or empty text has no ids and decodes to no bytes. Repeated rows are encoded each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import column, join_rows, keyed, stretches
from wordloom.llm.merging import BITS, LONG, Memory, Merger, in_bytes, laid_out
from wordloom.sources.scratch import materialise

CHUNK, OVERLAP = 1 << 15, 1 << 9
#: A pre-token that ends so many characters before a chunk's end would end there in the whole text too. True of patterns that look
#: ahead by less than so many characters, as the public one does.
CERTAIN = 4
#: Bytes of pre-tokens and ids that a task remembers.
CACHE_BYTES = 64 << 20
#: Texts are encoded about so many bytes at a time, and decoded so many ids.
SLICE = 1 << 20


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the neighbouring pair of lowest rank is merged first, the leftmost among equals."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged away
    before = list(range(-1, n - 1))
    pairs = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(pairs)
    while pairs:
        _, i, stop = heapq.heappop(pairs)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            joined = piece[i : end[stop]]
            if joined in ranks:
                heapq.heappush(pairs, (ranks[joined], i, end[stop]))
        if before[i] >= 0:
            joined = piece[before[i] : stop]
            if joined in ranks:
                heapq.heappush(pairs, (ranks[joined], before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """From texts to their ids as 32-bit numbers. The different pre-tokens of a call are looked up, new ones merged together."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_bytes: int = CACHE_BYTES):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.symbol = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        halves = ((token[:at], token[at:], i) for token, i in ranks.items() for at in range(1, len(token)))
        pairs = {ranks[a] << BITS | ranks[b]: i for a, b, i in halves if a in ranks and b in ranks}
        self.merger = Merger(pairs, np.arange(max(ranks.values()) + 1))
        self.memory = Memory(self.learn, cache_bytes)

    def learn(self, parts: list[str]) -> list[bytes]:
        raw = [p.encode() for p in parts]
        size = np.array([len(r) if r not in self.ranks else 0 for r in raw], np.int64)
        joined = b"".join([r for r, n in zip(raw, size) if n])
        found = self.merger.merge(self.symbol[np.frombuffer(joined, np.uint8)], size)
        for i in np.flatnonzero((size == 0) | (size > LONG)).tolist():
            found[i] = merge(raw[i], self.ranks)
        return in_bytes(found)

    def encode(self, texts: list[str]) -> list[bytes]:
        lists = [self.split.findall(t) for t in texts]
        encoded, ends = laid_out(pa.array(chain.from_iterable(lists), pa.string()), self.memory.ids_of)
        borders = np.concatenate([[0], ends])[np.cumsum([0, *map(len, lists)])].tolist()
        return [encoded[a:b].tobytes() for a, b in zip(borders, borders[1:])]


def with_ids(batch: pa.RecordBatch, keep: list[str], encoded: list[bytes]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), np.int32)))
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), ids], names=[*keep, "ids"])


def encode_whole(rows: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, pattern)
        for batch in batches:
            sizes = [n.as_py() or 0 for n in pc.binary_length(batch.column(batch.schema.get_field_index("text")))]
            for start, stop in stretches(sizes, SLICE):
                part = batch.slice(start, stop - start)
                yield with_ids(part, ["row_key", "id"], encoder.encode([t or "" for t in column(part, "text")]))

    return rows.select("row_key", "id", "text").mapInArrow(run, f"row_key long, id {dict(rows.dtypes)['id']}, ids array<int>")


def chunks(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """row_key, id, chunk, last (whether the text ends with it), start, text of overlapping chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(column(batch, "text")):
                starts = range(0, max(1, len(text) - overlap), size)
                keys = [batch.column(batch.schema.get_field_index(c)).take(pa.array([i] * len(starts))) for c in ("row_key", "id")]
                rest = [
                    pa.array(range(len(starts)), pa.int32()),
                    pa.array([s == starts[-1] for s in starts]),
                    pa.array(list(starts), pa.int64()),
                    pa.array([text[s:] if s == starts[-1] else text[s : s + size + overlap] for s in starts]),
                ]
                yield pa.RecordBatch.from_arrays([*keys, *rest], names=["row_key", "id", "chunk", "last", "start", "text"])

    kind = dict(rows.dtypes)["id"]
    return rows.select("row_key", "id", "text").mapInArrow(run, f"row_key long, id {kind}, chunk int, last boolean, start long, text string")


def with_borders(parts: DataFrame, pattern: str, size: int, overlap: int) -> DataFrame:
    """Where pre-tokens start in the part shared with the chunk before (heads) and after (tails), as positions in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for text, start, last in zip(column(batch, "text"), column(batch, "start"), column(batch, "last")):
                head, tail = [0], []
                for m in split.finditer(text):
                    at = m.end()
                    if not last and at > len(text) - CERTAIN:
                        break
                    if at < overlap:
                        head.append(at)
                    if at >= size and not last:
                        tail.append(at)
                heads.append([start + h for h in head])
                tails.append([start + t for t in tail])
            added = [pa.array(x, pa.list_(pa.int64())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), *added], names=[*batch.schema.names, "heads", "tails"])

    schema = ", ".join([*(f"{n} {t}" for n, t in parts.dtypes), "heads array<long>, tails array<long>"])
    return parts.mapInArrow(run, schema)


def encode_long(rows: DataFrame, ranks: dict[bytes, int], pattern: str, size: int, overlap: int) -> DataFrame:
    """Texts of several chunks: row_key, id, ids (null where two chunks could not be stitched)."""
    parts = chunks(rows, size, overlap).repartition(F.col("row_key"), F.col("chunk"))
    order = Window.partitionBy("row_key").orderBy("chunk")
    stitched = with_borders(parts, pattern, size, overlap)
    meet = F.array_min(F.array_intersect("tails", F.lead("heads").over(order)))
    stitched = stitched.select("row_key", "id", "chunk", "last", "start", "text", meet.alias("to"))
    stitched = stitched.withColumn("from", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.lag("to").over(order)))
    stitched = stitched.repartition(F.col("row_key"), F.col("chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, pattern)
        for batch in batches:
            found = []
            for text, start, last, low, high in zip(*(column(batch, c) for c in ("text", "start", "last", "from", "to"))):
                whole = low is not None and (last or high is not None)
                found += encoder.encode([text[low - start :] if last else text[low - start : high - start]]) if whole else [b""]
            keep = with_ids(batch, ["row_key", "id", "chunk"], found)
            fine = [low is not None and (last or high is not None) for last, low, high in zip(*(column(batch, c) for c in ("last", "from", "to")))]
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(fine)], names=[*keep.schema.names, "fine"])

    kind = dict(rows.dtypes)["id"]
    encoded = stitched.mapInArrow(run, f"row_key long, id {kind}, chunk int, ids array<int>, fine boolean")
    joined = encoded.groupBy("row_key").agg(F.first("id").alias("id"), F.min("fine").alias("fine"), F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    return joined.select("row_key", "id", F.when(F.col("fine"), F.flatten(F.col("parts.ids"))).alias("ids"))


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    text_col: str = "text",
    id_col: str = "doc_id",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """One row per document: row_key, id, ids."""
    rows = keyed(docs, id_col, {"text": text_col})
    long_text = F.coalesce(F.length("text"), F.lit(0)) > chunk
    short = encode_whole(rows.where(~long_text), ranks, pattern)
    stitched = materialise(encode_long(rows.where(long_text), ranks, pattern, chunk, overlap), "stitched")
    odd = materialise(stitched.where("ids IS NULL").select("row_key"), "unstitched")
    out = short.unionByName(stitched.where("ids IS NOT NULL"))
    if odd.isEmpty():
        return out
    return out.unionByName(encode_whole(join_rows(rows.where(long_text), odd, "row_key", "left_semi"), ranks, pattern))


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The table with ``ids`` replaced by the concatenated bytes of its tokens, ``decoded``, and the ids kept."""
    names = [n for n in encoded.columns if n != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        size = np.array([len(t) for t in tokens], np.int64)
        first, raw = np.cumsum(size) - size, np.frombuffer(b"".join(tokens), np.uint8)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            counts = [n.as_py() or 0 for n in pc.list_value_length(lists)]
            for start, stop in stretches(counts, SLICE):
                ids = lists.slice(start, stop - start).flatten().to_numpy(zero_copy_only=False)
                own = size[ids]
                ends = np.cumsum(own)
                joined = raw[np.repeat(first[ids] - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)]
                offsets = np.concatenate([[0], ends])[np.cumsum([0, *counts[start:stop]])].astype(np.int32)
                decoded = pa.Array.from_buffers(pa.binary(), stop - start, [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), decoded], names=[*names, "decoded"])

    kinds = dict(encoded.dtypes)
    return encoded.select(*names).mapInArrow(run, ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "decoded binary"]))
