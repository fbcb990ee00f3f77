import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from wordloom.functions.stopwords import LIST_NAMES, stopword_lists
from wordloom.plans import oracles

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

JOBS = """csv_source load_training_data csv_sink model_store select_columns process_table validate_rows row_errors
null_cells remove_punctuation remove_special_chars convert_to_lowercase convert_to_uppercase remove_stopwords
valid_word_filter stemming lemmatization clean_text detect_language language_profiles language_gate
class_distribution remove_low_classes balance_distribution train_test_split vectorize_count vectorize_tfidf
vectorize_hashing vectorizer_transform classify_svm classify_random_forest classify_logistic classify_naive_bayes
classify_decision_tree classify_knn classify_gradient_boosting accuracy classification_report train_model
model_selection predict_class classify_table predict_table process_and_classify""".split()


def test_every_job_is_registered(spark):
    assert set(JOBS) <= set(entry.queries()) and len(JOBS) == 44
    assert set(JOBS) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_session_and_jars(tmp_path):
    """Queries and SQL can be listed by a process that has no session and sees no jars of Spark."""
    program = "import pyspark; pyspark.__file__ = '/nowhere/pyspark/__init__.py'; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    queries, texts = map(int, done.stdout.split())
    assert queries >= texts >= 44


def test_stop_words_are_those_of_spark(spark):
    from pyspark.ml.feature import StopWordsRemover

    for code, name in LIST_NAMES.items():
        assert list(stopword_lists()[code]) == [w.strip() for w in StopWordsRemover.loadDefaultStopWords(name)]


def test_one_bad_text_takes_no_other_along(monkeypatch):
    good = dict(oracles.builders())

    def broken():
        raise RuntimeError("no text")

    monkeypatch.setattr(oracles, "builders", lambda: good | {"stemming": broken})
    assert set(oracles.oracles()) == set(good) - {"stemming"}


def test_entry(spark):
    assert entry.entry(spark).count() == 200


@pytest.mark.parametrize("name", ["detect_language", "stemming", "balance_distribution", "train_test_split", "process_table"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "labels", "events", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    mine = entry.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, mine), key=repr) == sorted(result.fetchall(), key=repr)
