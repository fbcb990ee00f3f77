"""Text to weighted terms, as rows ``(id, term, weight)``.

Terms are counted inside the row, so counting and hashing need no shuffle; hashing is done on numbers in Arrow, where a task hashes
every different word once. TF-IDF joins its vocabulary, and gathers the weighted
terms of a text in one array, where they are divided by their norm.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.arrays import bind, histogram
from wordloom.functions.batches import hashed_counts
from wordloom.functions.text import tokens
from wordloom.operators.inrow import frequent, weighted_words
from wordloom.operators.joins import is_small, lookup, lookup_by_tiers
from wordloom.operators.validate import check_columns
from wordloom.sources.scratch import materialise

HASH_BUCKETS = 2**20


def count_terms(df: DataFrame, id: str, col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Raw counts over the full vocabulary. Columns of ``keep`` stay on every row."""
    check_columns(df, [id, col])
    return df.select(id, *keep, F.explode(histogram(tokens(F.col(col)))).alias("h")).select(
        id, *keep, F.col("h.item").alias("term"), F.col("h.n").cast("bigint").alias("weight")
    )


def fit_vocabulary(df: DataFrame, id: str, col: str) -> DataFrame:
    """``(term, texts, idf)``, written: every term, the number of texts with it, and its smoothed idf."""
    texts = count_terms(df, id, col).groupBy("term").agg(F.count("*").alias("texts"))
    total = df.agg(F.count("*")).scalar()
    idf = F.log((1 + total) / (1 + F.col("texts"))) + 1
    return materialise(texts.withColumn("idf", idf), "vocabulary")


def _unit_length(vector: Column) -> Column:
    """An array of ``(term, weight)``, divided by its norm."""
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x["weight"] * x["weight"])
    return bind(F.sqrt(squares), lambda norm: F.transform(vector, lambda x: F.struct(x["term"].alias("term"), (x["weight"] / norm).alias("weight"))))


def term_counts(vocabulary: DataFrame) -> DataFrame | None:
    """``(term, n)`` of the texts a vocabulary was fitted on, which tells the frequent terms without another count."""
    return vocabulary.select("term", F.col("texts").alias("n")) if "texts" in vocabulary.columns else None


def apply_vectorizer(
    df: DataFrame, id: str, col: str, vocabulary: DataFrame, keep: Sequence[str] = ()
) -> DataFrame:
    """Weigh the terms of new texts by a fitted vocabulary; terms it does not hold are dropped.

    ``vocabulary`` is the written table of ``fit_vocabulary``. With an ``idf`` column the result is TF-IDF of
    unit length per text, without one it is counts. The weighted terms of a text come together as one array, in which norm and
    weights are one expression; a small vocabulary is broadcast, so that only those arrays are shuffled, and nothing is sorted.
    """
    terms = count_terms(df, id, col, keep)
    counted = lookup_by_tiers(terms, vocabulary, "term", "texts") if "texts" in vocabulary.columns else lookup(terms, vocabulary, "term", id)
    if "idf" not in vocabulary.columns:
        return counted.select(id, *keep, "term", "weight")
    weighted = counted.select(id, *keep, F.struct("term", (F.col("weight") * F.col("idf")).alias("weight")).alias("x"))
    vectors = weighted.groupBy(id, *keep).agg(F.collect_list("x").alias("vector"))
    return vectors.select(id, *keep, F.explode(_unit_length(F.col("vector"))).alias("v")).select(id, *keep, "v.term", "v.weight")


def weigh_unique(df: DataFrame, id: str, col: str, vocabulary: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``apply_vectorizer`` by TF-IDF for texts of unique ids.

    Frequent terms are weighed inside the row. The others, where not all of the vocabulary can be broadcast, are shuffled to meet it,
    and only the sum of their squares, a number per text, comes back.
    """
    inside, others = frequent(vocabulary.select("term", "texts", "idf"), "term", "texts", 2)
    words = weighted_words(tokens(F.col(col)), df.sparkSession.sparkContext.broadcast(inside.drop(["texts"])))
    found = df.select(id, *keep, words.alias("v")).select(id, *keep, "v.*")
    vector = F.explode("vector").alias("x")
    if others is None:
        return found.select(id, *keep, "squares", vector).select(id, *keep, "x.term", (F.col("x.weight") / F.sqrt("squares")).alias("weight"))
    rest = found.select(id, *keep, "squares", F.explode("rest").alias("r")).select(id, *keep, "squares", "r.term", "r.n")
    met = lookup(rest, others.select("term", "idf"), "term", id, False, term_counts(vocabulary))
    met = materialise(met.select(id, *keep, "squares", "term", (F.col("n") * F.col("idf")).alias("weight")), "rare-weights")
    norms = materialise(met.groupBy(id).agg(F.sum(F.col("weight") * F.col("weight")).alias("more")), "rare-norms")
    norms = F.broadcast(norms) if is_small(norms) else norms.hint("merge")
    norm = F.sqrt(F.col("squares") + F.coalesce("more", F.lit(0.0)))
    often = found.join(norms, id, "left").select(id, *keep, norm.alias("norm"), vector).select(id, *keep, "x.term", (F.col("x.weight") / F.col("norm")).alias("weight"))
    return often.unionByName(met.join(norms, id, "left").select(id, *keep, "term", (F.col("weight") / norm).alias("weight")))


def tfidf(df: DataFrame, id: str, col: str) -> DataFrame:
    """Count times ``ln((1 + n) / (1 + texts)) + 1``, scaled to unit length per text."""
    return apply_vectorizer(df, id, col, fit_vocabulary(df, id, col))


def _digest(term: Column) -> Column:
    return F.md5(term)


def _bucket(digest: Column, buckets: int) -> Column:
    return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("bigint") % buckets


def hashed(
    df: DataFrame,
    id: str,
    col: str,
    buckets: int = HASH_BUCKETS,
    signed: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(id, bucket, weight)`` without a vocabulary, of unit length per text.

    Terms of one bucket add up. ``signed`` gives each term a sign from its hash, so that collisions cancel on
    average; the weights are then no longer all positive, which Naive Bayes cannot use.
    """
    check_columns(df, [id, col])
    if signed:
        item = F.col("h.item")
        sign = F.when(F.substring(_digest(item), 9, 1) < "8", 1).otherwise(-1)
        summed = (
            df.select(id, *keep, F.explode(histogram(tokens(F.col(col)))).alias("h"))
            .select(id, *keep, _bucket(_digest(item), buckets).alias("term"), (F.col("h.n") * sign).alias("n"))
            .groupBy(id, *keep, "term")
            .agg(F.sum("n").cast("double").alias("weight"))
            .where("weight != 0")
        )
        vectors = summed.groupBy(id, *keep).agg(F.collect_list(F.struct("term", "weight")).alias("vector"))
        vector = _unit_length(F.col("vector"))
    else:
        vectors, vector = df, hashed_counts(tokens(F.col(col)), buckets)
    found = vectors.select(id, *keep, F.explode(vector).alias("v"))
    return found.select(id, *keep, F.col("v.term").alias("bucket"), "v.weight")


def fitting(vocabulary: DataFrame | None, kind: str) -> DataFrame | None:
    """The columns of a vocabulary that a vectorizer weighs by."""
    return vocabulary if vocabulary is None or kind == "TF-IDF" else vocabulary.drop("idf")


def vectorize(
    df: DataFrame,
    id: str,
    col: str,
    kind: str,
    vocabulary: DataFrame | None,
    buckets: int,
    keep: Sequence[str] = (),
    unique: bool = False,
) -> DataFrame:
    """``(id, *keep, term, weight)`` by one of the three vectorizers; hashing needs no vocabulary. ``unique`` says that ids are."""
    if kind == "Hashing":
        return hashed(df, id, col, buckets, keep=keep).withColumnRenamed("bucket", "term")
    if unique and kind == "TF-IDF" and "texts" in vocabulary.columns:
        return weigh_unique(df, id, col, vocabulary, keep)
    return apply_vectorizer(df, id, col, fitting(vocabulary, kind), keep)
