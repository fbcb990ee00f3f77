"""The whole pipeline, stage by stage, and the registered queries."""

import corpus_pipeline
import pytest

import __spark_entry__ as entry
from tests.llm.helpers import covered_words, words
from tests.llm.test_duplicates import expected_classes
from tests.llm.test_judging import brute_counts
from tests.llm.test_tokens import check_packing
from wordloom.llm.debruijn import WINDOW
from wordloom.llm.packing import SEQUENCE

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input of every stage and the result of the last, written as the pipeline writes them."""
    folder = tmp_path_factory.mktemp("stages")
    tables = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], SF).write.parquet(f"{folder}/{name}")
        tables.append(spark.read.parquet(f"{folder}/{name}"))
    return [t.orderBy("doc_id").collect() for t in tables]


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "passages", "packing"]
    assert all(r[0].asDict().keys() == stages[0][0].asDict().keys() for r in stages[1:5])
    assert [len(s) for s in stages] == sorted(map(len, stages[:5]), reverse=True) + [len(stages[5])]


def test_language_stage_keeps_clean_documents(stages):
    assert len(stages[1]) >= 0.98 * len(stages[0])


def test_quality_stage(stages):
    kept = {r["doc_id"] for r in stages[2]}
    for r in stages[1]:
        n, _, symbols, _, _, repeats = brute_counts(r["text"])
        if n < 50 or 100 * repeats > 50 * n or symbols > n:
            assert r["doc_id"] not in kept
        elif symbols < 0.1 * n and repeats < 0.1 * n:
            assert r["doc_id"] in kept


def test_near_duplicates_stage(stages):
    texts = [r["text"] for r in stages[2]]
    wanted = {stages[2][c]["doc_id"] for c in expected_classes(texts)}
    assert {r["doc_id"] for r in stages[3]} == wanted


def test_passages_stage(stages):
    texts = [r["text"] for r in stages[3]]
    for row, out, cover in zip(stages[3], stages[4], covered_words(texts, WINDOW), strict=True):
        kept = " ".join(w for w, c in zip(words(row["text"]), cover) if not c)
        assert out["text"] == (kept if any(cover) else row["text"]) and out["n_chars"] == len(out["text"])


def test_packing_stage(stages):
    texts = [r["text"] for r in stages[4]]
    place = {r["doc_id"]: i for i, r in enumerate(stages[4])}
    check_packing(texts, [r.asDict() | {"id": place[r["doc_id"]]} for r in stages[5]], SEQUENCE)


def test_odd_documents(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "a b", "en", None, 3), (None, "the and of " * 30, "en", "s", 330)]
    extra = "row_key int, rejected string, component int"
    docs = spark.createDataFrame([r + (1, "no", 2) for r in rows], f"{COLUMNS}, {extra}")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        found = out.collect()
        assert name == "packing" or out.columns == docs.columns, name
        assert len(found) == {"language": 2, "quality": 0, "near_duplicates": 4, "passages": 4, "packing": 4}[name]
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_every_operator_is_registered(spark):
    numbers = [int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in entry.queries()
