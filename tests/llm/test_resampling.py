"""Importance resampling against brute force and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb

from tests.llm.helpers import SCHEMA, prose, rows
from wordloom.llm import queries, resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(texts, ids, target):
    def bag(found):
        return Counter(zlib.crc32(f.encode()) % 10000 for t in found for f in features(t)[1])

    source, wanted = bag(texts), bag(target)
    every, all_wanted = sum(source.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (every + 10000) / ((source[b] + 1) * (all_wanted + 10000)))) for b in range(10000)}
    out = []
    for i, text in zip(ids, texts):
        words, found = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in found)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    rank = {r[0]: n for n, r in enumerate(able[: 5 * len(able) // 100], 1)}
    return [(*r, rank.get(r[0])) for r in out]


def test_resampling_is_that_of_brute_force(spark):
    rng = random.Random(5)
    odd = [None, "", "  ", "É é ÀB_c 東京 x1\x00y", "A" * 5000, "one two", "ünï-cödé " * 30]
    texts = odd + [prose(rng, rng.randrange(60)) for _ in range(400)] + ["the same " * 12] * 100 + [prose(rng, 30_000)]
    target = [prose(rng, 50, 40) for _ in range(20)] + [None]
    ids = rng.sample(range(10**6), len(texts))
    table = spark.createDataFrame(rows(texts, ids), SCHEMA).repartition(6)
    found = resampling.resample(table, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    got = [tuple(r[c] for c in ("id", "n_words", "n_features", "weight", "score", "rank")) for r in found]
    assert sorted(got, key=repr) == sorted(brute(texts, ids, target), key=repr)


def test_ties_odd_ids_and_no_rows(spark):
    text, target = "word " * 30, spark.createDataFrame([], "text string")
    table = spark.createDataFrame(rows([text] * 100 + [None], [7] * 60 + [None] * 41), SCHEMA)
    found = resampling.resample(table, target).collect()
    assert len(found) == 101 and sorted(r["rank"] for r in found if r["rank"]) == [1, 2, 3, 4, 5]
    assert len({r["score"] for r in found if r["n_words"]}) == 2
    assert resampling.resample(spark.createDataFrame([], SCHEMA), target).count() == 0
    assert [r["rank"] for r in resampling.resample(spark.createDataFrame(rows(["few words"]), SCHEMA), target).collect()] == [None]


def test_query_is_its_sql(spark):
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = con.execute(queries.ORACLES["op13_importance_resampling"])
    names = [c[0] for c in result.description]
    mine = queries.op13_importance_resampling(spark, folder).select(*names).collect()
    assert sorted(map(tuple, mine), key=repr) == sorted(result.fetchall(), key=repr)
