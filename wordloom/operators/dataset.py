"""Class counts, balancing and splitting.

Samples are drawn by the order of ``md5(seed:id)``. A sample of exact size is then everything up to one cut, so
selecting rows is a comparison inside the row. The cut comes from counts per hash bucket: no global sort, and
no class or table is ever gathered in one task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.operators.validate import check_columns
from wordloom.sources.scratch import materialise

# Hash prefix of four hex digits: 65,536 buckets.
BUCKET_DIGITS = 4


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Rows per class; rows without a class are not counted."""
    check_columns(df, [target])
    return df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))


def remove_low_classes(df: DataFrame, target: str) -> DataFrame:
    """Keep the classes with at least the mean number of rows."""
    counts = materialise(class_distribution(df, target), "class-counts")
    total = counts.agg(F.sum("n")).scalar()
    classes = counts.agg(F.count("*")).scalar()
    kept = counts.where(F.col("n") * classes >= total).select(target)
    return df.join(kept, target, "left_semi")


def _hash(id: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")))


def _bucket(h: Column) -> Column:
    return F.left(h, F.lit(BUCKET_DIGITS))


def balance(df: DataFrame, id: str, target: str, seed: int = 42) -> DataFrame:
    """As many rows of every class as the smallest class has, drawn without replacement."""
    check_columns(df, [id, target])
    keyed = df.where(F.col(target).isNotNull()).select(target, F.col(id).alias("_id"), _hash(id, seed).alias("_h"))
    # At most 65,536 rows per class, whatever the size of the class.
    buckets = materialise(
        keyed.groupBy(target, _bucket(F.col("_h")).alias("_bucket")).agg(F.count("*").alias("n")), "class-buckets"
    )
    smallest = buckets.groupBy(target).agg(F.sum("n").alias("n")).agg(F.min("n")).scalar()
    running = F.sum("n").over(Window.partitionBy(target).orderBy("_bucket"))
    edge = (
        buckets.withColumn("upto", running)
        .withColumn("need", smallest - (F.col("upto") - F.col("n")))
        .where((F.col("need") > 0) & (F.col("need") <= F.col("n")))
        .select(target, "_bucket", "need")
    )
    # Only the rows of one bucket per class are ranked: about 1/65,536 of the class.
    rank = F.row_number().over(Window.partitionBy(target, "_bucket").orderBy("_h", "_id"))
    cuts = materialise(
        keyed.withColumn("_bucket", _bucket(F.col("_h")))
        .join(edge, [target, "_bucket"])
        .withColumn("_rank", rank)
        .where(F.col("_rank") == F.col("need"))
        .select(target, F.struct("_h", "_id").alias("_cut")),
        "class-cuts",
    )
    drawn = F.struct(_hash(id, seed).alias("_h"), F.col(id).alias("_id")) <= F.col("_cut")
    return df.join(cuts, target).where(drawn).drop("_cut").select(*df.columns)


def split(df: DataFrame, id: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``, true for exactly ``ceil(test_size * n)`` rows, drawn without regard to class."""
    if not 0 < test_size < 1:
        raise ValueError(f"test_size must lie between 0 and 1, not {test_size}")
    check_columns(df, [id])
    keyed = df.select(F.col(id).alias("_id"), _hash(id, seed).alias("_h"))
    buckets = keyed.groupBy(_bucket(F.col("_h")).alias("_bucket")).agg(F.count("*").alias("n"))
    # One task, but over 65,536 rows at most.
    whole = Window.partitionBy(F.lit(0))
    edge = (
        buckets.withColumn("upto", F.sum("n").over(whole.orderBy("_bucket")))
        .withColumn("wanted", F.ceil(F.lit(float(test_size)) * F.sum("n").over(whole)))
        .withColumn("need", F.col("wanted") - (F.col("upto") - F.col("n")))
        .where((F.col("need") > 0) & (F.col("need") <= F.col("n")))
        .select("_bucket", "need")
    )
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", "_id"))
    cut = (
        keyed.withColumn("_bucket", _bucket(F.col("_h")))
        .join(F.broadcast(edge), "_bucket")  # a single row
        .withColumn("_rank", rank)
        .where(F.col("_rank") == F.col("need"))
        .select("_h", "_id")
        .first()
    )
    if cut is None:
        return df.withColumn("is_test", F.lit(False))
    # The cut is one hash and one id, so later jobs need not look for it again.
    last = F.lit(cut["_id"]).cast(keyed.schema["_id"].dataType)
    h = _hash(id, seed)
    return df.withColumn("is_test", (h < cut["_h"]) | ((h == cut["_h"]) & (F.col(id) <= last)))


def draw(df: DataFrame, id: str, n: int, seed: int = 42) -> DataFrame:
    """About ``n`` rows, and no more than all of them: those whose hash falls below the share that ``n`` is of the table.

    A comparison in the row, so nothing is sorted or gathered; the share is exact to a few square roots of ``n``.
    """
    check_columns(df, [id])
    total = df.count()
    if total <= n:
        return df
    place = F.conv(F.left(_hash(id, seed + 1), F.lit(12)), 16, 10).cast("double") / float(16**12)
    return df.where(place < n / total)


BALANCING = ("use_as_is", "remove_low_classes", "balance_distribution")


def balance_action(df: DataFrame, id: str, target: str, action: str, seed: int = 42) -> DataFrame:
    """Apply one of the three named ways to prepare the classes."""
    if action not in BALANCING:
        raise ValueError(f"unknown balancing action {action!r}, use one of {BALANCING}")
    if action == "remove_low_classes":
        return remove_low_classes(df, target)
    if action == "balance_distribution":
        return balance(df, id, target, seed)
    return df
