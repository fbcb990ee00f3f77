"""What the operators of this folder share: row keys, joins, components, slices of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import wordloom
from wordloom.sources.scratch import materialise

# Executors need numpy and pyarrow, but not this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(wordloom)

#: Texts are worked on in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def keyed(df: DataFrame, id_col: str, columns: dict[str, str]) -> DataFrame:
    """``row_key``, the id as ``id`` and the ``columns`` (new name to old name) of a table.

    The id is the row key when it is an integer without nulls and repeats. Otherwise the rows are numbered once in a
    written table, so null and repeated ids keep one result row each.
    """
    kind = dict(df.dtypes)[id_col]
    picked = df.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{old}`").alias(new) for new, old in columns.items()])
    if kind in ("tinyint", "smallint", "int", "bigint"):
        faulty = picked.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL")
        if faulty.isEmpty():
            return picked.select(F.col("id").cast("long").alias("row_key"), "*")
    return materialise(picked.select(F.monotonically_increasing_id().alias("row_key"), "*"), "numbered")


def join_rows(df: DataFrame, right: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join texts with a written table of one row per text, by a sort-merge join at every size: the table grows with the
    corpus, so it is never broadcast."""
    return df.join(right.hint("merge"), on, how)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: ``(node, component)`` for every node with an edge; the component is its smallest node.

    Large-star and small-star rounds (Kiveris et al., 2014): each round is a minimum per node and a join, written to the
    shared folder, until no edge changes.
    """
    spark = edges.sparkSession
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    last = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        large = materialise(large, "edges")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def slices(texts: Iterable[str | None], limit: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """Consecutive texts as UTF-8 (null: empty), about ``limit`` bytes at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text.encode() if text else b"")
        size += len(held[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def stretches(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """From where to where consecutive items go together, about ``limit`` at a time; a larger item ends its stretch."""
    start = total = 0
    for i, size in enumerate(sizes, 1):
        total += size
        if total >= limit:
            yield start, i
            start, total = i, 0
    if start < len(sizes):
        yield start, len(sizes)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
