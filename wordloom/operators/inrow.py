"""Looking words up inside the row: what a table knows of frequent words travels with the tasks, only rare words are shuffled.

The words of a batch of texts are numbered in Arrow, counted by text and number, and every different word of the batch is looked up
once. So a text's weighted sums need no row per word, and words that did not travel leave the text as a short list.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import wordloom
from wordloom.functions.batches import joined, offsets
from wordloom.operators import joins

# Executors need numpy and pyarrow, but not this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(wordloom)


def frequent(table: DataFrame, key: str, n: str, numbers: int) -> tuple[pa.Table, DataFrame | None]:
    """The rows with the largest ``n``, as many as may be broadcast, and the others; none when all may be.

    ``table`` is written, has one row per ``key``, a word, and about ``numbers`` numbers beside it. The driver holds what travels.
    """
    size = F.octet_length(key) + 8 * (numbers + 2)
    levels = table.groupBy(F.floor(F.log2(F.greatest(F.col(n), F.lit(1)))).cast("int").alias("level")).agg(F.sum(size.cast("bigint")).alias("bytes"))
    cut, taken, whole = None, 0, True
    for row in sorted(levels.collect(), key=lambda r: -r["level"]):
        taken += row["bytes"]
        if taken > joins.BROADCAST_BYTES:
            whole = False
            break
        cut = 2 ** row["level"]
    if whole:
        return table.toArrow().combine_chunks(), None
    above = F.lit(False) if cut is None else F.greatest(F.col(n), F.lit(1)) >= cut
    return table.where(above).toArrow().combine_chunks(), table.where(~above)


def array_of(table: pa.Table, name: str) -> pa.Array:
    """A column as one array."""
    column = table.column(name).combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def places(words: pa.Array, keys: pa.Array) -> np.ndarray:
    """Where each word stands among ``keys``; -1: nowhere."""
    return pc.fill_null(pc.index_in(words, value_set=keys.cast(words.type)), -1).to_numpy(zero_copy_only=False)


def counted(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Text, word and count of every different word of every text, in the order of the words; words are numbers of the last array."""
    coded = lists.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    texts = np.repeat(np.arange(len(lists), dtype=np.int64), np.diff(offsets(lists)))
    # A row of a batch and a word of a batch have fewer than 32 bits.
    facts = np.sort(texts << 32 | rank[coded.indices.to_numpy()])
    first = np.flatnonzero(np.diff(facts, prepend=-1))
    n = np.diff(first, append=len(facts))
    facts = facts[first]
    return facts >> 32, facts & 0xFFFFFFFF, n, coded.dictionary.take(pa.array(order))


def lists_of(texts: np.ndarray, size: int, values: pa.Array) -> pa.ListArray:
    """The values of each text as a list; ``texts`` are in order."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(texts, minlength=size))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def replaced(words: Column, shipped) -> Column:
    """The words of an array, each by its ``lemma`` in the broadcast ``(word, lemma)`` where there is one, joined by single spaces."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keys, lemmas = (array_of(shipped.value, c) for c in ("word", "lemma"))
        for batch in batches:
            coded = batch.flatten().dictionary_encode()
            at = places(coded.dictionary, keys)
            changed = pc.if_else(pa.array(at >= 0), lemmas.take(pa.array(np.where(at >= 0, at, None), pa.int64())), coded.dictionary)
            yield joined(batch, changed.take(coded.indices))

    return F.arrow_udf("string")(run)(words)


def _rest(texts: np.ndarray, words: np.ndarray, n: np.ndarray, names: pa.Array, size: int) -> pa.ListArray:
    return lists_of(texts, size, pa.StructArray.from_arrays([names.take(pa.array(words)), pa.array(n)], ["term", "n"]))


def weighted_sums(words: Column, shipped, width: int) -> Column:
    """``(sums, weight, squares, rest)`` of every array of words.

    ``shipped`` is a broadcast table ``(term, idf, parts)``, ``parts`` of ``width`` numbers or missing. A word weighs its count times
    its idf; ``sums`` adds up the weighted parts, ``weight`` and ``squares`` the weights and their squares. ``rest`` are the
    words the table lacks, ``(term, n)``.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = shipped.value
        keys, idf, lists = (array_of(table, c) for c in ("term", "idf", "parts"))
        parts = np.zeros((len(keys), width))
        if width:
            parts[lists.is_valid().to_numpy(zero_copy_only=False)] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        idf = idf.to_numpy(zero_copy_only=False)
        for batch in batches:
            texts, codes, n, names = counted(batch)
            at = places(names, keys)[codes]
            known, size = at >= 0, len(batch)
            own, of = texts[known], at[known]
            w = n[known] * idf[of]
            sums = np.stack([np.bincount(own, w * parts[of, k], size) for k in range(width)], axis=1).reshape(-1) if width else np.zeros(0)
            ends = pa.array(np.arange(size + 1) * width, pa.int32())
            out = [pa.ListArray.from_arrays(ends, pa.array(sums)), pa.array(np.bincount(own, w, size)), pa.array(np.bincount(own, w * w, size))]
            yield pa.StructArray.from_arrays([*out, _rest(texts[~known], codes[~known], n[~known], names, size)], ["sums", "weight", "squares", "rest"])

    return F.arrow_udf("sums array<double>, weight double, squares double, rest array<struct<term: string, n: bigint>>")(run)(words)


def weighted_words(words: Column, shipped) -> Column:
    """``(vector, squares, rest)`` of every array of words: the words that the broadcast ``(term, idf)`` has, ``(term, weight)`` in
    their order, by count times idf, the sum of the squares of the weights, and the words it lacks, ``(term, n)``."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = shipped.value
        keys, idf = array_of(table, "term"), array_of(table, "idf").to_numpy(zero_copy_only=False)
        for batch in batches:
            texts, codes, n, names = counted(batch)
            at = places(names, keys)[codes]
            known, size = at >= 0, len(batch)
            w = n[known] * idf[at[known]]
            entries = pa.StructArray.from_arrays([names.take(pa.array(codes[known])), pa.array(w)], ["term", "weight"])
            out = [lists_of(texts[known], size, entries), pa.array(np.bincount(texts[known], w * w, size))]
            yield pa.StructArray.from_arrays([*out, _rest(texts[~known], codes[~known], n[~known], names, size)], ["vector", "squares", "rest"])

    return F.arrow_udf("vector array<struct<term: string, weight: double>>, squares double, rest array<struct<term: string, n: bigint>>")(run)(words)
