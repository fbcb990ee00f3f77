"""Row ids, and joining a large fact table with a table of one row per key, when a few keys hold most of the facts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.sources.scratch import materialise

# A table that takes fewer bytes is broadcast; a larger one is joined by a shuffle with its hot keys salted.
BROADCAST_BYTES = 64_000_000
# A key is hot when it holds more than 1/HOT_SHARE of all facts, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1_000
SALTS = 64


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """The table with a number for every row, written once, so that it stays the same however often it is read."""
    if name in df.columns:
        raise ValueError(f"there is a column {name!r} already")
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def check_ids(df: DataFrame, id: str) -> None:
    """Jobs that join by id need one row per id: null and repeated ids are errors (``with_row_id`` makes good ones)."""
    bad = df.groupBy(id).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(id).isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"ids must be unique and not null: {bad[0][0]!r} stands in {bad[0]['n']} rows; see with_row_id")


def _bytes(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        size = F.octet_length(c)
    elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
        size = F.size(c) * 64
    else:
        return F.lit(8)
    return F.coalesce(size, F.lit(0)) + 24


def is_small(table: DataFrame) -> bool:
    """Whether all columns of all rows together are below the bound."""
    size = sum((_bytes(field) for field in table.schema.fields), F.lit(24))
    return (table.agg(F.sum(size.cast("bigint"))).first()[0] or 0) <= BROADCAST_BYTES


def lookup_by_tiers(facts: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """``lookup`` for facts that cost little to make twice and a written table that counts facts like them in its column ``n``.

    The most frequent keys, as many as can be broadcast, meet their facts in place. Only the facts of other keys are shuffled,
    and none of those keys is frequent, so none is salted.
    """
    size = sum((_bytes(field) for field in table.schema.fields), F.lit(24))
    levels = table.groupBy(F.floor(F.log2(n)).cast("int").alias("level")).agg(F.sum(size.cast("bigint")).alias("bytes")).collect()
    cut, taken = None, 0
    for row in sorted(levels, key=lambda r: -r["level"]):
        taken += row["bytes"]
        if taken > BROADCAST_BYTES:
            break
        cut = 2 ** row["level"]
    if taken <= BROADCAST_BYTES:
        return facts.join(F.broadcast(table), key)
    if cut is None:
        return lookup(facts, table, key, facts.columns[0], False, table.select(key, F.col(n).alias("n")))
    often, seldom = table.where(F.col(n) >= cut), table.where(F.col(n) < cut)
    others = facts.join(F.broadcast(often.select(key)), key, "left_anti")
    return facts.join(F.broadcast(often), key).unionByName(others.join(seldom, key))


def lookup(
    facts: DataFrame, table: DataFrame, key: str, spread_by: str, small: bool | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """Inner join on ``key``; ``table`` is a written table with one row per key.

    Hot keys are those of ``counts``, a written ``(key, n)`` of facts like these; without it they are counted on the facts
    themselves, which are then made twice. The result is the same whichever keys are taken for hot. Their facts are spread over ``SALTS`` partitions by ``spread_by``, and
    only the few hot rows of the table are repeated.
    """
    if is_small(table) if small is None else small:
        return facts.join(F.broadcast(table), key)
    if counts is None:
        counts = materialise(facts.groupBy(key).agg(F.count("*").alias("n")), "key-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # Fewer than HOT_SHARE rows, whatever the size of the table.
    hot = F.broadcast(counts.where(F.col("n") * HOT_SHARE > total).select(key, F.lit(SALTS).alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    salted_facts = facts.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread_by), salts))
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), (salts - 1).cast("bigint")))
    salted_table = table.join(hot, key, "left").withColumn("_salt", each)
    return salted_facts.drop("_salts").join(salted_table.drop("_salts"), [key, "_salt"]).drop("_salt")
