"""Words of a whole batch of texts in Arrow: what depends on a word alone is found once for every different word of a task.

Words are cut out by Spark's expressions, so that there is one rule for what a word is; only replacing them happens here.
"""

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

import wordloom

# Executors need numpy and pyarrow, but not this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(wordloom)

#: Different words a task remembers; beyond that it starts anew.
REMEMBERED = 200_000


def offsets(lists: pa.ListArray) -> np.ndarray:
    """Where each list starts among all values; a missing list has none."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)])


def joined(lists: pa.ListArray, words: pa.Array) -> pa.Array:
    """``words`` in place of those of ``lists``, joined by spaces; a missing list stays missing."""
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets(lists), pa.int32()), words), " ")
    return pc.if_else(lists.is_valid(), texts, None)


def text_by_word(words: Column, change: Callable[[str], str]) -> Column:
    """The words of an array, each by what ``change`` makes of it, joined by single spaces."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, str] = {}
        for batch in batches:
            if len(known) > REMEMBERED:
                known.clear()
            coded = batch.flatten().dictionary_encode()
            changed = []
            for word in coded.dictionary.to_pylist():
                if word not in known:
                    known[word] = change(word)
                changed.append(known[word])
            yield joined(batch, pa.array(changed, pa.string()).take(coded.indices))

    return F.arrow_udf("string")(run)(words)


def _bucket_of(word: bytes, buckets: int) -> int:
    """The first 32 bits of a word's digest, taken modulo the number of buckets."""
    return int.from_bytes(md5(word, usedforsecurity=False).digest()[:4], "big") % buckets


def hashed_counts(words: Column, buckets: int) -> Column:
    """The words of an array counted by hash bucket and divided by their norm: an array of ``(term, weight)``, ordered by term.

    A missing array has no terms.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[bytes, int] = {}
        for batch in batches:
            if len(known) > REMEMBERED:
                known.clear()
            coded = batch.flatten().dictionary_encode()
            bucket = []
            for word in coded.dictionary.cast(pa.binary()).to_pylist():
                if (found := known.get(word)) is None:
                    found = known[word] = _bucket_of(word, buckets)
                bucket.append(found)
            texts = np.repeat(np.arange(len(batch), dtype=np.int64), np.diff(offsets(batch)))
            # A bucket has 32 bits, a row of a batch has fewer.
            facts = np.sort(texts << 32 | np.array(bucket, np.int64)[coded.indices.to_numpy()])
            first = np.flatnonzero(np.diff(facts, prepend=-1))
            n = np.diff(first, append=len(facts)).astype(np.float64)
            text = facts[first] >> 32
            norms = np.sqrt(np.bincount(text, n * n, len(batch)))
            entries = pa.StructArray.from_arrays([pa.array(facts[first] & 0xFFFFFFFF), pa.array(n / norms[text])], ["term", "weight"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(batch)))])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)

    return F.arrow_udf("array<struct<term: bigint, weight: double>>")(run)(words)
