"""Accuracy and the per-class report."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: the share of rows whose prediction equals the label."""
    hit = F.coalesce((F.col(prediction) == F.col(label)).cast("double"), F.lit(0.0))
    return pred.agg(F.avg(hit).alias("accuracy"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def classification_report(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per label, then accuracy, macro and weighted averages.

    Labels are all that occur as label or prediction; a ratio without a denominator is 0. The accuracy row
    carries its value as F1. One pass counts the pairs, the rest works on those counts.
    """
    pairs = pred.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    hit = F.coalesce(F.col("y") == F.col("p"), F.lit(False))
    sides = F.array(
        F.struct(F.col("y").cast("string").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("p").cast("string").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    )
    per_label = (
        pairs.select(F.when(hit, F.col("n")).otherwise(0).alias("right"), F.explode(sides).alias("s"))
        .where("s.label IS NOT NULL")
        .groupBy(F.col("s.label").alias("label"))
        .agg(
            F.sum("s.support").alias("support"),
            F.sum("s.predicted").alias("predicted"),
            F.sum(F.when(F.col("s.support") > 0, F.col("right")).otherwise(0)).alias("right"),
        )
        .withColumn("precision", _ratio(F.col("right"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("right"), F.col("support")))
        .withColumn("f1", _ratio(2 * F.col("right"), F.col("support") + F.col("predicted")))
    )
    total = F.sum("support")

    def summary(name: str, precision: Column, recall: Column, f1: Column) -> Column:
        return F.struct(
            F.lit(name).alias("label"),
            precision.cast("double").alias("precision"),
            recall.cast("double").alias("recall"),
            f1.cast("double").alias("f1"),
            total.alias("support"),
        )

    def weighted(name: str) -> Column:
        return _ratio(F.sum(F.col(name) * F.col("support")), total)

    none = F.lit(None)
    summaries = per_label.agg(
        F.array(
            summary("accuracy", none, none, _ratio(F.sum("right"), total)),
            summary("macro avg", F.avg("precision"), F.avg("recall"), F.avg("f1")),
            summary("weighted avg", weighted("precision"), weighted("recall"), weighted("f1")),
        ).alias("rows")
    ).select(F.explode("rows").alias("r")).select("r.*")
    return per_label.select("label", "precision", "recall", "f1", "support").unionByName(summaries)
