"""From raw documents to packed training sequences: five stages, each over all that its predecessor kept.

Language identification, quality rules, near-duplicates, repeated passages, packing. Every stage but the last returns the
columns of its input; each is written as Parquet and read again as the next one's documents. Documents with null or repeated
ids are numbered for the time of a stage, so each of them is judged by itself. A document whose words were all removed stays,
with an empty text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import debruijn, langid, minhash, packing, quality
from wordloom.llm.common import join_rows, keyed
from wordloom.sources.scratch import materialise


def _with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents, and the column that tells them apart: the id, or a number where ids are null, repeated or no integers."""
    if dict(docs.dtypes)["doc_id"] == "bigint":
        faulty = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
        if faulty.isEmpty():
            return docs, "doc_id"
    name = "row_number"
    while name in docs.columns:
        name += "_"
    return materialise(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _keep(docs: DataFrame, judge: Callable[..., DataFrame]) -> DataFrame:
    """The documents that an operator keeps."""
    rows, key = _with_key(docs)
    kept = materialise(judge(rows, id_col=key).where("kept").select(F.col("row_key").alias(key)), "kept")
    return join_rows(rows, kept, key, "left_semi").select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the others go."""
    model = langid.train(docs.where(~langid.held_out()))
    return docs.where(~langid.judgement(model)("text")["rejected"])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outlier of their language and source."""
    return _keep(docs, quality.judge)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return _keep(docs, minhash.near_duplicates)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words or more that stand elsewhere too; texts without any stay as they are."""
    rows, key = _with_key(docs)
    spans = debruijn.repeated_spans(keyed(rows, key, {"text": "text"}))
    spans = spans.select(F.col("row_key").alias(key), F.col("starts").alias("__starts"), F.col("ends").alias("__ends"))
    cut = join_rows(rows, spans, key, "left")
    kept = F.when(F.col("__starts").isNotNull(), debruijn.cut_words("text", "__starts", "__ends")["kept"]).otherwise(F.col("text"))
    cut = cut.withColumn("text", kept)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return cut.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        packed = packing.pack(docs, file.read())
    return packed.withColumnRenamed("id", "doc_id").drop("row_key")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", minhash_stage),
    ("passages", passages_stage),
    ("packing", packing_stage),
]

#: Models, hashed signatures and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
