"""Packing of tokenized documents into fixed sequences: cutting stock by column generation.

Every document's ids, with an end id, are cut into full sequences and a remainder. The histogram of piece lengths, in steps of
``STEP`` ids, is the demand of a cutting-stock problem. Its linear relaxation is solved over patterns (which lengths share a
sequence): the simplex prices a new pattern by an unbounded knapsack, solved by dynamic programming, until none pays. The
patterns are rounded down, first-fit-decreasing covers what is left over; the problem has as many rows as there are length
steps, so the driver's part does not grow with the corpus. Each piece is ranked within its length step (a count per partition
and step, a running sum over the partitions, and the rank within the partition), and its rank names the pattern's copy and slot.

Defined results: a null text is empty and gives the end id alone. Repeated rows are packed each. An empty table gives no rows. A
special token's string in a text gives the special id, as the library's plain call does.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from wordloom.llm.common import column, keyed, stretches
from wordloom.llm.merging import Memory, laid_out
from wordloom.sources.scratch import materialise

SEQUENCE = 2048
STEP = 8
END_ID = 1
#: The column generation ends after so many pivots per length, if prices still improve then.
PIVOTS = 200
#: Bytes of words and ids that a task remembers.
CACHE_BYTES = 64 << 20
#: New words that are encoded in one call, and characters of texts that are worked on at a time.
CALL, SLICE = 256, 1 << 23
#: Texts and words without these characters are plain: composing changes nothing, and lower case is a matter of each character.
NOT_PLAIN = r"[^\x{0}-\x{12F}\x{131}-\x{2FF}\x{2010}-\x{2027}]"
#: The public tokenizer's steps before merging.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": PARTS}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class Encoder:
    """From texts to their ids as little-endian unsigned 32-bit numbers.

    For tokenizers that never look beyond white space, as those with word ends: the different words of a call are looked up, and
    new ones are encoded, many in one call, which costs a fraction of one call each; the ids' offsets tell them apart. Where the
    steps before merging are those of the public tokenizer, plain words are cut into their parts here, the library merges the
    parts, and the ids that end a part tell them apart. A text that holds a special token's string is encoded whole, so that the
    library finds it as it does anywhere.
    """

    def __init__(self, tokenizer: str, cache_bytes: int = CACHE_BYTES):
        settings = json.loads(tokenizer)
        self.tokenizer, self.model = tokenizer, Tokenizer.from_str(tokenizer)
        self.model.encode_special_tokens = True  # words that only look like one once they are in lower case
        self.special = [t["content"] for t in settings.get("added_tokens", [])]
        self.ignores_case = '"type": "Lowercase"' in json.dumps(settings.get("normalizer"))
        self.memory = Memory(self.learn, cache_bytes)
        self.cut, self.merger, self.ends = regex.compile(PARTS), None, np.zeros(0, bool)
        end, vocabulary = settings["model"].get("end_of_word_suffix"), settings["model"]["vocab"]
        known = settings.get("normalizer") == {"type": "Sequence", "normalizers": NORMAL}
        known = known and settings.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
        if known and end and all(b in vocabulary and b + end in vocabulary for b in ByteLevel.alphabet()):
            self.merger = Tokenizer(self.model.model)
            self.merger.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(end)]] = True

    @cached_property
    def whole(self) -> Tokenizer:
        return Tokenizer.from_str(self.tokenizer)

    def learn(self, words: list[str]) -> list[bytes]:
        plain = ~pc.match_substring_regex(pa.array(words, pa.string()), NOT_PLAIN).to_numpy(zero_copy_only=False) & (self.merger is not None)
        out = [b""] * len(words)
        for chosen, learned in ((plain, self.by_parts), (~plain, self.by_offsets)):
            some = np.flatnonzero(chosen).tolist()
            for i, ids in zip(some, learned([words[i] for i in some])):
                out[i] = ids
        return out

    def by_offsets(self, words: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(words), CALL):
            some = words[at : at + CALL]
            found = self.model.encode(" ".join(some), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in some])
            places = np.fromiter(map(itemgetter(0), found.offsets), np.int64, len(found))
            cuts = (4 * np.searchsorted(places, ends)).tolist()
            raw = np.array(found.ids, "<u4").tobytes()
            out += [raw[a:b] for a, b in zip([0, *cuts], cuts)]
        return out

    def by_parts(self, words: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(words), CALL):
            lists = [[w] if w.isalpha() else self.cut.findall(w) for w in map(str.lower, words[at : at + CALL])]
            (found,) = self.merger.encode_batch_fast([" ".join(chain.from_iterable(lists))], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends = np.concatenate([[0], 4 * (np.flatnonzero(self.ends[ids]) + 1)])
            cuts, raw = ends[np.cumsum([0, *map(len, lists)])].tolist(), ids.tobytes()
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        held, marked = pa.array(texts, pa.string()), [i for i, t in enumerate(texts) if any(mark in t for mark in self.special)]
        if marked:
            held = pc.if_else(pa.array(np.isin(np.arange(len(texts)), marked)), "", held)
        if self.ignores_case:  # lower letters make fewer different words
            held = pc.if_else(pc.match_substring_regex(held, NOT_PLAIN), held, pc.utf8_lower(held))
        split = pc.ascii_split_whitespace(held)
        encoded, ends = laid_out(split.flatten(), self.memory.ids_of)
        borders = np.concatenate([[0], ends])[np.cumsum([0, *pc.list_value_length(split).to_numpy()])].tolist()
        out = [encoded[a:b].tobytes() for a, b in zip(borders, borders[1:])]
        for i in marked:
            out[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        return out


def pieces(rows: DataFrame, tokenizer: str, sequence: int, end_id: int) -> DataFrame:
    """row_key, id, start, length, ids_crc32, doc_tokens of the pieces of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = Encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        names = ["row_key", "id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            out = []
            i = 0
            texts = [t or "" for t in column(batch, "text")]
            for low, high in stretches([len(t) for t in texts], SLICE):
                for ids in model.encode(texts[low:high]):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, sequence):
                        part = ids[4 * start : 4 * (start + sequence)]
                        out.append((i, start, len(part) // 4, zlib.crc32(part), n))
                    i += 1
            which, *numbers = (np.array(x, np.int64) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 5
            keys = [batch.column(batch.schema.get_field_index(c)).take(pa.array(which)) for c in ("row_key", "id")]
            yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, numbers)], names=names)

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"row_key long, id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits: its value and counts."""
    worth = np.full(room + 1, -1.0)
    worth[sizes] = values
    best, pick = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for r in range(1, room + 1):
        gain = worth[1 : r + 1] + best[r - 1 :: -1] if r > 1 else worth[1:2]
        i = int(gain.argmax())
        if gain[i] > best[r - 1] + 1e-12:
            best[r], pick[r] = gain[i], i + 1
        else:
            best[r] = best[r - 1]
    counts, r = np.zeros(len(sizes), np.int64), room
    while r > 0:
        if pick[r]:
            counts[np.searchsorted(sizes, pick[r])] += 1
        r -= max(1, int(pick[r]))
    return float(best[room]), counts


def patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (count of each size, which fit into ``room``) and how often each is used; together they cover the demand."""
    m = len(sizes)
    if not m:
        return []
    order = np.argsort(sizes)
    sizes, demand = sizes[order], demand[order]
    columns = [np.eye(m, dtype=np.int64)[i] * (room // sizes[i]) for i in range(m)]
    inverse = np.diag(1.0 / (room // sizes))
    used = inverse @ demand
    for _ in range(PIVOTS * (m + 1)):  # a bound against endless degenerate pivots; the patterns found by then are used
        prices = inverse.sum(axis=0)
        value, counts = knapsack(prices, sizes, room)
        if value <= 1 + 1e-7:
            break
        along = inverse @ counts
        steps = np.where(along > 1e-9, used / np.where(along > 1e-9, along, 1), np.inf)
        out = int(steps.argmin())
        used = used - steps[out] * along
        used[out] = steps[out]
        inverse[out] /= along[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(along[others], inverse[out])
        columns[out] = counts
    plan, left = [], demand.copy()
    for counts, x in zip(columns, used):
        times = int(max(0, np.floor(x + 1e-9)))
        # Never more copies than some of the remaining demand can fill.
        has = counts > 0
        times = min(times, int((left[has] // counts[has]).min())) if has.any() else 0
        if times:
            plan.append((counts, times))
            left = left - times * counts
    while left.any():
        counts, free = np.zeros(m, np.int64), room
        for i in range(m - 1, -1, -1):
            counts[i] = min(left[i], free // sizes[i])
            free -= counts[i] * sizes[i]
        has = counts > 0
        times = int((left[has] // counts[has]).min())
        plan.append((counts, times))
        left = left - times * counts
    back = np.argsort(order)
    return [(counts[back], times) for counts, times in plan]


def slots(sizes: np.ndarray, plan: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: first rank, first sequence and slot number of every stretch of ranks that fills one slot of a pattern."""
    out: dict[int, list[tuple[int, int, int]]] = {int(s): [] for s in sizes}
    rank = dict.fromkeys(out, 0)
    base = 0
    for counts, times in plan:
        slot = 0
        for i in np.flatnonzero(counts)[::-1]:
            size = int(sizes[i])
            for _ in range(int(counts[i])):
                out[size].append((rank[size], base, slot))
                rank[size] += times
                slot += 1
        base += times
    return {s: tuple(np.array(x, np.int64) for x in zip(*rows)) for s, rows in out.items() if rows}


def pack(
    docs: DataFrame,
    tokenizer: str,
    text_col: str = "text",
    id_col: str = "doc_id",
    sequence: int = SEQUENCE,
    step: int = STEP,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: row_key, id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``tokenizer`` is the JSON."""
    rows = keyed(docs, id_col, {"text": text_col})
    cut = pieces(rows, tokenizer, sequence, end_id).withColumn("part", F.spark_partition_id())
    cut = materialise(cut.withColumn("size", F.ceil(F.col("length") / step).cast("int")), "pieces")
    counts = materialise(cut.groupBy("part", "size").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = sorted(map(tuple, counts.groupBy("size").agg(F.sum("n")).collect()))
    sizes = np.array([s for s, _ in histogram], np.int64)
    demand = np.array([n for _, n in histogram], np.int64)
    table = slots(sizes, patterns(sizes, demand, sequence // step))

    before = F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("part", "size", F.coalesce(before, F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("part", "size").orderBy("row_key", "start")) - 1
    ranked = cut.withColumn("nth", nth).join(firsts, ["part", "size"])
    ranked = ranked.select("*", (F.col("first") + F.col("nth")).alias("rank")).drop("part", "first", "nth")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (np.array(column(batch, c), np.int64) for c in ("size", "rank"))
            where, slot = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                first, base, number = table[int(s)]
                mine = size == s
                i = np.searchsorted(first, rank[mine], "right") - 1
                where[mine], slot[mine] = base[i] + rank[mine] - first[i], number[i]
            names = [n for n in batch.schema.names if n not in ("size", "rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(where), pa.array(slot)], names=[*names, "sequence_id", "slot"])

    kinds = [f"`{n}` {t}" for n, t in ranked.dtypes if n not in ("size", "rank")]
    placed = ranked.mapInArrow(place, ", ".join([*kinds, "sequence_id long, slot long"]))
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("slot")
