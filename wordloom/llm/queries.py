"""The registered queries of this folder, and SQL for those that it can express."""

from __future__ import annotations

import base64

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import alignment, bpe, caps, debruijn, html_cut, langid, licenses, minhash, packing, quality, resampling, sentencepieces, suffixes


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def byte_ranks() -> dict[bytes, int]:
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_ranks()
    decoded = bpe.decode(bpe.encode(_read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return decoded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("class_key").alias("class_id"), "kept")


def op3_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(_read(spark, sf_dir, "documents"))
    spans = (F.size("removed") / 2).cast("long").alias("n_spans")
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", spans, F.sha2("kept", 256).alias("kept_sha256"))


def op4_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = caps.near_duplicates(_read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_read(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"])
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        F.coalesce(F.array_max("scores"), F.lit(0.0)).alias("score"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_read(spark, sf_dir, "documents"))
    counts = [F.col(f"counts.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return found.select(F.col("id").alias("doc_id"), *counts, "base_failed", "kept", F.col("d2").alias("distance"))


def op8_html_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_cut.extract(_read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op7_debruijn_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = debruijn.remove_repeats(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def word_tokenizer() -> str:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def op10_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), word_tokenizer()).withColumnRenamed("id", "doc_id").drop("row_key")


def byte_tokenizer() -> str:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def piece_model() -> bytes:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(_read(spark, sf_dir, "documents"), byte_tokenizer(), piece_model())
    counts = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return found.select(F.col("id").alias("doc_id"), *counts, "groups_sha256")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_model()
    found = sentencepieces.decode(sentencepieces.encode(_read(spark, sf_dir, "documents"), model), model)
    return found.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_dart_minhash,
        op3_suffix_sort,
        op4_cap_filters,
        op5_license_scan,
        op6_quality_rules,
        op7_debruijn_repeats,
        op8_html_min_cut,
        op9_language_id,
        op10_cutting_stock,
        op11_cross_tokenizer,
        op12_sentencepiece,
        op13_importance_resampling,
    )
}

#: The checksum is worked out bit by bit and byte by byte, by the polynomial 0xEDB88320.
RESAMPLING = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c
    FROM (SELECT unnest(range(256)) AS i))),
texts AS (
  SELECT doc_id, text, 's' AS side FROM documents UNION ALL SELECT NULL, text, 't' FROM benchmark),
numbered AS (SELECT row_number() OVER () AS r, * FROM texts),
words AS (
  SELECT r, doc_id, side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM numbered),
runs AS (
  SELECT r, side, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM words),
counted AS (SELECT r, side, f, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT f, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::BIGINT),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295)) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted), crc_table),
cells AS (SELECT r, side, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
bags AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM cells GROUP BY bucket),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM bags),
gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS g FROM bags, totals),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM cells JOIN gain USING (bucket) WHERE side = 's' GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (r) WHERE side = 's'),
places AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 5 * count(*) OVER () // 100 AS wanted
  FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= wanted THEN place END AS rank
FROM scored LEFT JOIN places USING (doc_id)
"""

ORACLES: dict[str, str] = {"op13_importance_resampling": RESAMPLING}
