"""Importance resampling towards a target: hashed n-gram features, log ratios of two bags, Gumbel top share.

A text is worked on as UTF-8 bytes: a table of 256 bytes lower-cases A-Z and turns every separator into a space, ``bytes.split``
gives the words. The CRC-32 of a run of words is that of the run before it, continued over the next word (the seed argument of
``zlib.crc32``), so runs of one to ``RUN`` words cost one short checksum each. Tasks count buckets (the CRC modulo ``BUCKETS``) in
a Counter, Spark adds the counters, and the driver gets ``BUCKETS`` sums for the corpus and for the target, whatever their size.
The gain of a bucket is the rounded log ratio of its smoothed shares; a text's weight is the sum over its runs. Texts are drawn
without replacement by adding Gumbel noise, made of a hash of the id, and taking the highest scores: the rows are dealt by ranges of
the score, numbered within a range, and the ranges' sizes give where each begins.

Defined results: a null or empty text, or one without words, has no features and weight 0; texts of fewer than ``MIN_WORDS`` words
are weighed but never drawn. Ties go to the smaller id, rows of the same id (repeated or null; null ids come first, and are hashed
as empty) to the row that was numbered first. Repeated rows count and are weighed each. Without any text that may be drawn all
ranks are null; an empty table gives no rows, an empty target gives a gain to every bucket all the same (one is added to each).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import column, keyed, stretches
from wordloom.sources.scratch import materialise

BUCKETS = 10_000
RUN = 3
MIN_WORDS = 20
#: So many of a hundred texts are drawn.
PERCENT = 5
SEED = 42
#: Lower-cases A-Z, keeps a-z, digits and all bytes beyond ASCII, and turns the others into spaces.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Texts are worked on about so many characters at a time.
SLICE = 1 << 20


def checksums(text: str, run: int = RUN) -> tuple[int, list[int]]:
    """The number of words, and the CRC-32 of every run of up to ``run`` words joined by a space."""
    words = text.encode().translate(TABLE).split()
    found = last = list(map(zlib.crc32, words))
    spaced = list(map(b" ".__add__, words))
    for n in range(1, run):
        last = list(map(zlib.crc32, spaced[n:], last))
        found = found + last
    return len(words), found


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """How many runs of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            texts = column(batch, "text")
            for start, stop in stretches([len(t or "") for t in texts], SLICE):
                found = [c for t in texts[start:stop] if t for c in checksums(t, run)[1]]
                counts.update((np.array(found, np.int64) % buckets).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (counts.keys(), counts.values())], names=["bucket", "n"])

    sums = rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():  # one row per bucket at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's share in the target to its share in the source."""
    every, wanted = int(source.sum()) + len(source), int(target.sum()) + len(target)
    ratios = [float((t + 1) * every) / float((s + 1) * wanted) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weigh(rows: DataFrame, gain: np.ndarray, run: int = RUN, seed: int = SEED) -> DataFrame:
    """row_key, id, n_words, n_features, weight, score of every text."""
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    noise = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), F.lit(8)), 16, 10).cast("long")

    def run_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sizes, weights = [], [], []
            texts = [t or "" for t in column(batch, "text")]
            for start, stop in stretches([len(t) for t in texts], SLICE):
                found = [checksums(t, run) for t in texts[start:stop]]
                size = np.array([len(c) for _, c in found], np.int64)
                sums = np.concatenate([[0], np.cumsum(gain[np.array([x for _, c in found for x in c], np.int64) % len(gain)])])
                ends = np.cumsum(size)
                counts += [n for n, _ in found]
                sizes += size.tolist()
                weights += (sums[ends] - sums[ends - size]).tolist()
            drawn = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in column(batch, "noise")]
            scores = [w + g for w, g in zip(weights, drawn)]
            keys = [batch.column(batch.schema.get_field_index(c)) for c in ("row_key", "id")]
            numbers = [pa.array(x, pa.int64()) for x in (counts, sizes, weights, scores)]
            yield pa.RecordBatch.from_arrays([*keys, *numbers], names=["row_key", "id", "n_words", "n_features", "weight", "score"])

    schema = f"row_key long, id {dict(rows.dtypes)['id']}, n_words long, n_features long, weight long, score long"
    return rows.select("row_key", "id", "text", noise.alias("noise")).mapInArrow(run_texts, schema)


def numbered(scored: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``rank`` of the drawn rows (1 is the highest score), null for the others."""
    order = [(F.col("n_words") < min_words).asc(), F.col("score").desc(), F.col("id").asc(), F.col("row_key").asc()]
    schema = ", ".join([*(f"{n} {t}" for n, t in scored.dtypes), "part long, nth long"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first = TaskContext.get().partitionId(), 1
        for batch in batches:
            added = [pa.array([part] * batch.num_rows, pa.int64()), pa.array(range(first, first + batch.num_rows), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "part", "nth"])
            first += batch.num_rows

    # A written table: the ranges of a second run of this plan might begin elsewhere.
    dealt = materialise(scored.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema), "ranges")
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_words") >= min_words).alias("able"))
    sizes = sorted(map(tuple, sizes.collect()))  # one row per partition
    wanted = sum(able for _, _, able in sizes) * percent // 100
    if not wanted:
        return dealt.select("*", F.lit(None).cast("long").alias("rank")).drop("part", "nth")
    begins = list(accumulate((n for _, n, _ in sizes), initial=0))
    ranges = dealt.sparkSession.createDataFrame([(part, begin) for (part, _, _), begin in zip(sizes, begins)], "part long, begin long")
    place = F.col("begin") + F.col("nth")
    # One row per partition: a bounded table.
    return dealt.join(F.broadcast(ranges), "part").withColumn("rank", F.when(place <= wanted, place)).drop("part", "nth", "begin")


def resample(
    docs: DataFrame,
    target: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    target_col: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """One row per document: row_key, id, n_words, n_features, weight, score, rank (null if it is not drawn)."""
    rows = keyed(docs, id_col, {"text": text_col})
    gain = gains(bucket_counts(rows), bucket_counts(target.select(F.col(f"`{target_col}`").alias("text"))))
    return numbered(materialise(weigh(rows, gain), "scored"), min_words, percent)
