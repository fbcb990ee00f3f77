"""Removal of repeated byte strings by a hash-compared suffix sort.

Suffixes are compared by their longest common extension, found by binary search over prefix polynomial hashes, so a comparison
takes about nine hash lookups; a merge sort orders them, neighbours with an extension of ``WINDOW`` bytes are equal, and equal
neighbours are verified byte by byte.

The sort is spread by anchors: the anchor of a ``WINDOW``-byte string is its ``GRAM``-byte piece of smallest hash, so equal
strings have equal anchors at equal offsets. Neighbouring strings of a text that share an anchor form a segment. Segments whose
anchor stands once are dropped by a grouped count. Segments with equal surroundings (a digest of all bytes of their strings) are
one class, counted before any text moves; a class of two or more is repeated as a whole. Only one member of each class takes
part in the sort, and only where an anchor has several classes. An anchor with more than ``CROWD`` classes is not sorted in one
task: its strings are counted one by one by their digests, over all tasks.

Defined results: null and empty texts have no bytes. Texts shorter than the window lose nothing. Repeated rows repeat each
other, so all their windows go. Texts of any length are worked on whole, in overlapping blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import column, join_rows, keyed
from wordloom.llm.hashing import BLOCK, Powers, in_text, minimizers, mix, runs
from wordloom.sources.scratch import materialise

WINDOW = 400
GRAM = 256
CROWD = 4096
#: Bytes of surroundings that are sorted at a time.
UNIT = 1 << 20


def blocks(texts: list[str | None], window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) of the texts, about a block at a time; a longer text comes in blocks that share window - 1 bytes."""
    held, size = [], 0
    for i, text in enumerate(texts):
        data = text.encode() if text else b""
        for at in range(0, max(1, len(data) - window + 1), BLOCK):
            held.append((i, at, data[at : at + BLOCK + window - 1]))
            size += len(held[-1][2])
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def segments(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """row_key, anchor (hash), pos (of the anchor), start (first string), n (further strings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            keys = np.array(column(batch, "row_key"), np.int64)
            for part in blocks(column(batch, "text"), window):
                data = np.frombuffer(b"".join(x[2] for x in part), np.uint8)
                first = np.concatenate([[0], np.cumsum([len(x[2]) for x in part])])
                at = in_text(first, window)
                if not len(at):
                    continue
                values = mix(powers.windows(powers.prefix(powers.codes[data]), gram))
                picks = minimizers(values, window - gram + 1)[at]
                low, high = runs(picks, at)
                start, pos = at[low], picks[low]
                owner = np.searchsorted(first, start, "right") - 1
                # Texts that touch have no string across their border, so a run never leaves its text.
                shift = np.array([x[1] for x in part], np.int64)[owner] - first[owner]
                who = np.array([x[0] for x in part], np.int64)[owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[who]), pa.array(values[pos].view(np.int64)), pa.array((pos + shift).astype(np.int32)), pa.array((start + shift).astype(np.int32)), pa.array((high - low).astype(np.int16))],
                    names=["row_key", "anchor", "pos", "start", "n"],
                )

    return rows.select("row_key", "text").mapInArrow(run, "row_key long, anchor long, pos int, start int, n short")


def surroundings(rows: DataFrame, window: int) -> DataFrame:
    """row_key, anchor, back (anchor's offset), n, start, digest of each listed segment's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, marks in zip(column(batch, "row_key"), column(batch, "text"), column(batch, "marks")):
                data = memoryview((text or "").encode())
                for m in marks:
                    digest = blake2b(data[m["start"] : m["start"] + m["n"] + window], digest_size=16).digest()
                    out.append((key, m["anchor"], m["pos"] - m["start"], m["n"], m["start"], digest))
            yield table(out, "row_key", "anchor", "back", "n", "start", "digest")

    return rows.select("row_key", "text", "marks").mapInArrow(run, "row_key long, anchor long, back int, n int, start int, digest binary")


KINDS = {"row_key": pa.int64(), "anchor": pa.int64(), "back": pa.int32(), "n": pa.int32(), "start": pa.int32(), "end": pa.int32(), "digest": pa.binary(), "single": pa.bool_(), "content": pa.binary()}


def table(rows: list[tuple], *names: str) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[n]) for c, n in zip(columns, names)], names=list(names))


def contents(rows: DataFrame, window: int) -> DataFrame:
    """The bytes of each listed segment; for crowded anchors a digest of each of its strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row_key", "anchor", "back", "n", "start", "single", "content", "digest"]
        for batch in batches:
            out, size = [], 0
            for key, text, marks in zip(column(batch, "row_key"), column(batch, "text"), column(batch, "marks")):
                data = (text or "").encode()
                for m in marks:
                    if m["crowded"]:
                        for s in range(m["start"], m["start"] + m["n"] + 1):
                            out.append((key, m["anchor"], 0, 0, s, m["single"], None, blake2b(data[s : s + window], digest_size=16).digest()))
                    else:
                        out.append((key, m["anchor"], m["back"], m["n"], m["start"], m["single"], data[m["start"] : m["start"] + m["n"] + window], None))
                        size += m["n"] + window
                    if size + 64 * len(out) > 4 * UNIT:
                        yield table(out, *names)
                        out, size = [], 0
            yield table(out, *names)

    return rows.select("row_key", "text", "marks").mapInArrow(run, "row_key long, anchor long, back int, n int, start int, single boolean, content binary, digest binary")


class Comparer:
    """Compares the strings of ``window`` bytes at positions of one array."""

    def __init__(self, data: np.ndarray, window: int, powers: Powers):
        self.data, self.window, self.powers = data, window, powers
        self.prefix = powers.prefix(powers.codes[data])

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix, by binary search."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.window, np.int64)
        for _ in range(self.window.bit_length()):
            middle = (low + high + 1) >> 1
            same = self.powers.ranges(self.prefix, x, x + middle) == self.powers.ranges(self.prefix, y, y + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether x is smaller than y, and whether they are equal."""
        common = self.extension(x, y)
        equal = common >= self.window
        common = np.where(equal, 0, common)
        return ~equal & (self.data[x + common] < self.data[y + common]), equal

    def verify(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the bytes are equal."""
        out = np.empty(len(x), bool)
        reach = np.arange(self.window)
        for at in range(0, len(x), 4096):
            s = slice(at, at + 4096)
            out[s] = (self.data[x[s, None] + reach] == self.data[y[s, None] + reach]).all(axis=1)
        return out


def merge_sort(places: np.ndarray, group: np.ndarray, comparer: Comparer) -> np.ndarray:
    """The places (ordered by group) sorted within each group. All runs of one length are merged at once: an element's new
    place is its own rank plus its rank in the sibling run, found by binary search with hash-compared suffixes."""
    n = len(places)
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([begin, [n]]))
    base, size = np.repeat(begin, sizes), np.repeat(sizes, sizes)
    local = np.arange(n) - base
    width = 1
    while n and width < sizes.max():
        mine = local // width
        sibling = (mine ^ 1) * width
        todo = np.flatnonzero(sibling < size)
        low = base[todo] + sibling[todo]
        high = np.minimum(low + width, base[todo] + size[todo])
        from_left = (mine[todo] & 1) == 0
        first = low.copy()
        active = np.arange(len(todo))
        while len(active):
            middle = (low[active] + high[active]) >> 1
            smaller, equal = comparer.less(places[middle], places[todo[active]])
            # Ties keep the left run first.
            right = smaller | (equal & ~from_left[active])
            low[active] = np.where(right, middle + 1, low[active])
            high[active] = np.where(right, high[active], middle)
            active = active[low[active] < high[active]]
        new = np.arange(n)
        left_run = base[todo] + (mine[todo] & ~1) * width
        new[todo] = left_run + (local[todo] - mine[todo] * width) + (low - first)
        out = np.empty_like(places)
        out[new] = places
        places = out
        width *= 2
    return places


def sort_unit(part: list[dict], window: int, powers: list[Powers]) -> list[tuple[int, int, int]]:
    """(row_key, start, end) of repeated strings among the surroundings of some anchors."""
    data = np.frombuffer(b"".join(p["content"] for p in part), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(p["content"]) for p in part])[:-1]]).astype(np.int64)
    n = np.array([p["n"] for p in part], np.int64) + 1
    owner = np.repeat(np.arange(len(part)), n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    anchor = np.unique(np.array([p["anchor"] for p in part], np.int64), return_inverse=True)[1]
    # Equal strings have one anchor at one offset.
    group = anchor[owner] * (window + 1) + np.array([p["back"] for p in part], np.int64)[owner] - step
    order = np.argsort(group, kind="stable")
    counts = np.unique(group[order], return_counts=True)[1]
    order = order[np.repeat(counts, counts) > 1]
    if not len(order):
        return []
    place = first[owner] + step
    origin = np.zeros(len(data), np.int64)
    origin[place] = np.arange(len(place))
    for hashes in powers:
        comparer = Comparer(data, window, hashes)
        done = merge_sort(place[order], group[order], comparer)
        mates = np.flatnonzero(group[order][1:] == group[order][:-1])
        equal = mates[comparer.extension(done[mates], done[mates + 1]) >= window]
        if comparer.verify(done[equal], done[equal + 1]).all():
            break
    else:
        raise ValueError("both hashes collide")
    hit = np.unique(origin[np.concatenate([done[equal], done[equal + 1]])])
    low, high = runs(owner[hit], hit)
    out = []
    for a, b in zip(hit[low], hit[high]):
        p = part[owner[a]]
        if p["single"]:
            out.append((p["row_key"], p["start"] + int(step[a]), p["start"] + int(step[b]) + window))
    return out


def sorted_spans(held: DataFrame, window: int) -> DataFrame:
    """The suffix sort of every anchor's surroundings: row_key, start, end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [Powers(0), Powers(1)]
        part, size, last = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if size >= UNIT and row["anchor"] != last:
                    yield table(sort_unit(part, window, powers), "row_key", "start", "end")
                    part, size = [], 0
                part.append(row)
                size += len(row["content"])
                last = row["anchor"]
        if part:
            yield table(sort_unit(part, window, powers), "row_key", "start", "end")

    dealt = held.drop("digest").repartition(F.col("anchor")).sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "row_key long, start int, end int")


def without_spans(rows: DataFrame) -> DataFrame:
    """row_key, id, n_bytes, n_removed, removed (start and end of each removed run, in turn), kept (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, removed, kept = [], [], [], []
            for text, starts, ends in zip(column(batch, "text"), column(batch, "starts"), column(batch, "ends")):
                data = (text or "").encode()
                cut: list[int] = []
                for s, e in sorted(zip(starts or (), ends or ())):
                    if cut and s <= cut[-1]:
                        cut[-1] = max(cut[-1], e)
                    else:
                        cut += [s, e]
                edges = [0, *cut, len(data)]
                n_bytes.append(len(data))
                n_removed.append(sum(cut[1::2]) - sum(cut[::2]))
                removed.append(cut)
                kept.append(b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in ("row_key", "id")), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, pa.list_(pa.int64())), pa.array(kept, pa.binary())],
                names=["row_key", "id", "n_bytes", "n_removed", "removed", "kept"],
            )

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"row_key long, id {kind}, n_bytes long, n_removed long, removed array<long>, kept binary")


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """One row per document: row_key, id, n_bytes, n_removed, removed, kept."""
    rows = keyed(docs, id_col, {"text": text_col})
    found = materialise(segments(rows, window, gram), "segments")
    shared = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    # Written tables on both sides of a join let Spark split the partition of a frequent anchor.
    marks = found.hint("merge").join(materialise(shared, "shared-anchors"), "anchor")
    marks = marks.groupBy("row_key").agg(F.collect_list(F.struct("anchor", "pos", "start", "n")).alias("marks"))
    around = surroundings(join_rows(rows, materialise(marks, "marks"), "row_key", "inner"), window)
    around = materialise(around, "surroundings")

    key = ["anchor", "back", "n", "digest"]
    classes = around.groupBy(*key).agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("row_key", "start")).alias("rep"))
    classes = materialise(classes, "classes")
    copies = around.hint("merge").join(classes.where("members > 1").select(*key), key)
    copies = copies.select("row_key", "start", (F.col("start") + F.col("n") + window).alias("end"))

    mixed = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes"), F.min("members").alias("fewest")).where("classes > 1 AND fewest = 1")
    reps = classes.hint("merge").join(materialise(mixed, "mixed-anchors"), "anchor")
    reps = reps.select(
        F.col("rep.row_key").alias("row_key"),
        F.struct("anchor", "back", "n", F.col("rep.start").alias("start"), (F.col("members") == 1).alias("single"), (F.col("classes") > crowd).alias("crowded")).alias("mark"),
    )
    reps = materialise(reps.groupBy("row_key").agg(F.collect_list("mark").alias("marks")), "open")
    held = materialise(contents(join_rows(rows, reps, "row_key", "inner"), window), "contents")
    by_sort = sorted_spans(held.where("content IS NOT NULL"), window)
    one_by_one = held.where("digest IS NOT NULL")
    twice = one_by_one.groupBy("digest").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("digest")
    by_digest = one_by_one.hint("merge").join(materialise(twice, "repeated-strings"), "digest").select("row_key", "start", (F.col("start") + window).alias("end"))

    spans = copies.unionByName(by_sort).unionByName(by_digest)
    spans = spans.groupBy("row_key").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    return without_spans(join_rows(rows, materialise(spans, "spans"), "row_key", "left"))
