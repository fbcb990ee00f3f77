import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from wordloom.constants import (
    ENTER_TEXT,
    LABEL_MAPS,
    PREDICTION_ERROR,
    UNKNOWN_CLASS,
    UNSUPPORTED_LANGUAGE,
)
from wordloom.operators import dataset, joins, kernels, knn, vectorize
from wordloom.operators.mllib import build_classifier, fit_pipeline, fit_vectorizer
from wordloom.operators.naive_bayes import nb_fit, nb_predict
from wordloom.options import TREE_BUCKETS, CleanOptions, ModelConfig
from wordloom.plans import models, queries, workflow
from wordloom.sources.scratch import materialise

#: What the registered classifiers learn by.
REGISTERED = [c for q in queries.QUERIES.values() for cell in q.__closure__ or () if isinstance(c := cell.cell_contents, ModelConfig)]

TOPICS = {
    1: "minister parliament war treaty border nation embassy",
    2: "goal match team player coach league stadium",
    3: "market shares profit bank trade investor dollar",
}


@pytest.fixture(scope="module")
def topics(spark):
    rows = []
    for label, words in TOPICS.items():
        vocabulary = words.split()
        for i in range(20):
            chosen = [vocabulary[(i + j * j) % 7] for j in range(4)] + ["today", "report"][: i % 3]
            rows.append((label * 100 + i, " ".join(chosen), label))
    return spark.createDataFrame(rows, "id bigint, text string, category int")


def weights(df):
    out = {}
    for row in df.collect():
        out.setdefault(row[0], {})[row[1]] = row[2]
    return out


def test_vectorizers(spark):
    df = spark.createDataFrame([(1, "aa bb aa x"), (2, "bb cc"), (3, "")], "id int, text string")
    assert weights(vectorize.count_terms(df, "id", "text")) == {1: {"aa": 2, "bb": 1}, 2: {"bb": 1, "cc": 1}}
    aa, bb = 2 * (math.log(4 / 2) + 1), math.log(4 / 3) + 1
    tfidf = weights(vectorize.tfidf(df, "id", "text"))
    assert tfidf[1]["aa"] == pytest.approx(aa / math.hypot(aa, bb))
    vocabulary = vectorize.fit_vocabulary(df, "id", "text")
    new = spark.createDataFrame([(9, "aa zz")], "id int, text string")
    assert weights(vectorize.apply_vectorizer(new, "id", "text", vocabulary)) == {9: {"aa": pytest.approx(1.0)}}
    assert weights(vectorize.apply_vectorizer(new, "id", "text", vocabulary.drop("idf"))) == {9: {"aa": 1}}


def test_hashing_adds_up_collisions(spark):
    df = spark.createDataFrame([(1, "aa bb aa cc dd")], "id int, text string")
    one = weights(vectorize.hashed(df, "id", "text", buckets=1))
    assert one == {1: {0: pytest.approx(1.0)}}
    wide = weights(vectorize.hashed(df, "id", "text"))[1]
    assert len(wide) == 4 and sum(w * w for w in wide.values()) == pytest.approx(1.0)
    signed = weights(vectorize.hashed(df, "id", "text", signed=True))[1]
    assert {b: abs(w) for b, w in signed.items()} == pytest.approx(wide)


def test_hashed_terms_are_counted_in_arrow(spark):
    """Every bucket against a plain count; colliding, repeated, missing and empty texts in one batch; no sort of terms in the JVM."""
    texts = [None, "aa bb aa", "", "cc aa", "x", "Éa éA zz " * 50, None, "dd"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    found = vectorize.hashed(df, "id", "text", buckets=3)
    expected = {}
    for i, text in enumerate(texts):
        words = [w for w in (text or "").lower().split() if len(w) > 1]
        n = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 3 for w in words)
        norm = math.sqrt(sum(v * v for v in n.values()))
        expected.update({(i, b): v / norm for b, v in n.items()})
    assert {(r.id, r.bucket): r.weight for r in found.collect()} == expected
    assert "sort_array" not in found._jdf.queryExecution().toString()


def brute_naive_bayes(train, test, vocabulary):
    """``train``: [(label, {term: weight})]; scores by the textbook."""
    labels = sorted({label for label, _ in train})
    out = []
    for terms in test:
        scores = {}
        for label in labels:
            rows = [t for found, t in train if found == label]
            sums = Counter()
            for t in rows:
                sums.update(t)
            total = sum(sums.values()) + len(vocabulary)
            scores[label] = math.log(len(rows) / len(train)) + sum(
                w * math.log((sums[t] + 1) / total) for t, w in terms.items() if t in vocabulary
            )
        out.append(max(labels, key=lambda c: (round(scores[c], 6), -c)))
    return out


def test_naive_bayes_equals_the_textbook(spark, topics):
    counted = vectorize.count_terms(topics, "id", "text")
    labels = topics.select("id", F.col("category").alias("label")).where("id % 3 > 0")
    model = nb_fit(counted, labels)
    out = {r.id: r.prediction for r in nb_predict(counted, model, topics.select("id")).collect()}
    rows = weights(counted)
    known = {r.id: r.label for r in labels.collect()}
    expected = brute_naive_bayes(
        [(known[i], rows[i]) for i in known], [rows[i] for i in sorted(rows)], {t for r in rows.values() for t in r}
    )
    assert [out[i] for i in sorted(rows)] == expected


def test_naive_bayes_without_known_terms_takes_the_most_frequent_class(spark):
    df = spark.createDataFrame([(1, "aa", 5), (2, "aa", 5), (3, "bb", 4)], "id int, text string, label int")
    terms = vectorize.count_terms(df, "id", "text")
    model = nb_fit(terms, df.select("id", "label"))
    new = spark.createDataFrame([(1, "zz"), (2, None), (3, "bb bb")], "id int, text string")
    out = nb_predict(vectorize.count_terms(new, "id", "text"), model, new.select("id")).collect()
    assert {r.id: r.prediction for r in out} == {1: 5, 2: 5, 3: 4}


def brute_knn(train, test, k):
    """``train``: {id: (label, vector)}, ``test``: {id: vector}."""
    out = {}
    for key, v in test.items():
        near = sorted(
            (round(sum((v.get(t, 0) - w.get(t, 0)) ** 2 for t in v.keys() | w.keys()), 9), i) for i, (_, w) in train.items()
        )
        votes = Counter(train[i][0] for _, i in near[:k])
        out[key] = min(votes, key=lambda c: (-votes[c], c))
    return out


@pytest.mark.parametrize("shard, finish, kind", [(32_000_000, 4, "TF-IDF"), (900, 0, "Count"), (2_000, 0, "TF-IDF")])
def test_knn_equals_brute_force(spark, topics, monkeypatch, shard, finish, kind):
    monkeypatch.setattr(knn, "SHARD_BYTES", shard)
    monkeypatch.setattr(knn, "FINISH_COST", finish)
    # A third of all rows are copies of one text, and some texts are empty.
    copies = spark.range(1000, 1030).select("id", F.lit("goal goal market").alias("text"), (F.col("id") % 3 + 1).cast("int").alias("category"))
    empty = spark.createDataFrame([(2001, "", 3), (2002, "", 2), (2003, "", 2)], "id bigint, text string, category int")
    df = topics.unionByName(copies).unionByName(empty)
    vocabulary = vectorize.fit_vocabulary(df, "id", "text")
    terms = vectorize.vectorize(df, "id", "text", kind, vocabulary, 0)
    train, test = df.where("id % 4 > 0"), df.where("id % 4 = 0 or id = 2003")
    labels = train.select("id", F.col("category").alias("label"))
    out = knn.knn_predict(
        terms.join(train.select("id"), "id"), labels, terms.join(test.select("id"), "id"), 3, test.select("id")
    )
    vectors = weights(terms)
    expected = brute_knn(
        {r.id: (r.label, vectors.get(r.id, {})) for r in labels.collect()},
        {r.id: vectors.get(r.id, {}) for r in test.collect()},
        3,
    )
    assert {r.id: r.prediction for r in out.collect()} == expected


@pytest.mark.parametrize("signed", [False, True])
def test_bounds_skip_lists_and_lose_nothing(signed):
    rng = np.random.default_rng(3)
    names = [f"t{i}" for i in range(400)]

    def vector():
        # A few rare terms and many common ones, as in texts.
        at = sorted(set(rng.integers(0, 400, 4)) | set(rng.integers(0, 30, 25)))
        w = np.where(np.array(at) < 30, 0.1, 3.0) * rng.random(len(at)) * (rng.choice([-1, 1], len(at)) if signed else 1)
        return [names[i] for i in at], w

    train, owners = [vector() for _ in range(3000)], [[(i, i % 3)] for i in range(3000)]
    index = knn.Index([t for t, _ in train], [w.tolist() for _, w in train], owners)
    dense = np.zeros((3000, 400))
    for i, (terms, w) in enumerate(train):
        dense[i, [int(t[1:]) for t in terms]] = w
    everything = 0
    for terms, w in [vector() for _ in range(40)] + [([], np.zeros(0)), (["unknown"], np.ones(1))]:
        query = np.zeros(400)
        known = [int(t[1:]) for t in terms if t in index.column]
        query[known] = w[: len(known)]
        d2 = np.round(((dense - query) ** 2).sum(axis=1) + (1 if terms == ["unknown"] else 0), 9)
        wanted = np.lexsort((np.arange(3000), d2))[:5]
        found = index.nearest(terms, w, 5)
        assert found[0] == pytest.approx(d2[wanted], abs=2e-9) and set(found[2]) == set(i % 3 for i in found[1])
        assert sorted(found[1]) == sorted(wanted.tolist())
        everything += sum(index.start[index.column[t] + 1] - index.start[index.column[t]] for t in terms if t in index.column)
    assert signed or index.seen < everything / 4


@pytest.mark.parametrize("signed, scale, together", [(False, 1.0, {}), (True, 1.0, {}), (False, 300.0, {}), (True, 1.0, {"BLOCK": 7, "HITS": 50, "DENSE_TERMS": 9}), (False, 1.0, {"CELLS": 1, "DENSE_CELLS": 0})])
def test_texts_that_go_past_indexes_together_find_what_each_finds_alone(monkeypatch, signed, scale, together):
    for name, value in together.items():
        monkeypatch.setattr(knn, name, value)
    rng = np.random.default_rng(5)

    def vector():
        at = sorted(set(rng.integers(0, 300, 4)) | set(rng.integers(0, 30, 12)))
        w = scale * np.where(np.array(at) < 30, 0.2, 1.0) * rng.integers(1, 4, len(at)) * (rng.choice([-1, 1], len(at)) if signed else 1)
        return [f"t{i}" for i in at], w / 4

    train = [vector() for _ in range(600)]
    train[100:140] = train[:40]  # equal distances: the smaller rank goes first
    indexes = [
        knn.Index([t for t, _ in train[a:b]], [w.tolist() for _, w in train[a:b]], [[(i, i % 3), (1000 + i, 1)] for i in range(a, b)])
        for a, b in ((0, 3), (3, 200), (200, 201), (201, 600))
    ]
    texts = [vector() for _ in range(60)] + train[:5] + [([], np.zeros(0)), (["unknown"], np.ones(1))]
    names = sorted({t for terms, _ in texts for t in terms})
    codes = np.array([names.index(t) for terms, _ in texts for t in terms])
    starts = np.concatenate([[0], np.cumsum([len(terms) for terms, _ in texts])])
    alone, joint = ([[] for _ in texts] for _ in range(2))
    farthest = np.full(len(texts), np.inf)
    for index in indexes:
        for i, (terms, w) in enumerate(texts):
            alone[i] = sorted([*alone[i], *zip(*map(np.ndarray.tolist, index.nearest(terms, w, 5)))])[:5]
        for i, *found in index.nearer(names, starts, codes, np.concatenate([w for _, w in texts]), 5, farthest):
            joint[i] = sorted([*joint[i], *zip(*map(np.ndarray.tolist, found))])[:5]
            farthest[i] = joint[i][-1][0] if len(joint[i]) == 5 else np.inf
    assert [[x[1:] for x in found] for found in joint] == [[x[1:] for x in found] for found in alone]
    assert np.allclose([[x[0] for x in found] for found in joint], [[x[0] for x in found] for found in alone], atol=2e-9)


def test_knn_reads_the_texts_to_score_once_and_shuffles_none(spark, topics):
    vocabulary = vectorize.fit_vocabulary(topics, "id", "text")
    terms = vectorize.vectorize(topics, "id", "text", "TF-IDF", vocabulary, 0)
    labels = topics.select("id", F.col("category").alias("label"))
    vectors = materialise(knn.packed_vectors(topics.select("id"), terms), "vectors")
    plan = knn.knn_score(vectors, knn.knn_fit(terms, labels, 3), 3, labels.schema["label"].dataType)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "Exchange" not in text
    assert knn.knn_predict(terms.limit(0), labels.limit(0), terms).where("prediction IS NULL").count() == 60


def test_knn_shards_are_built_by_tasks_and_read_one_at_a_time(spark, topics, monkeypatch):
    monkeypatch.setattr(knn, "SHARD_BYTES", 900)
    terms = vectorize.count_terms(topics, "id", "text")
    labels = topics.select("id", F.col("category").alias("label"))
    shards = knn.knn_fit(terms, labels, 3)
    # The driver holds names; the indexes are a table, and one shard is read without the others.
    assert shards.count > 3 and not any(isinstance(v, knn.Index) for v in vars(shards).values())
    assert 3 < shards.table.count() <= shards.count and shards.table.where("shard = 0").inputFiles()
    rows = [knn.Index.read(bytes(r.raw)) for r in shards.table.collect()]
    ids = sorted(r.id for r in topics.collect())
    order = np.argsort(np.concatenate([r.ranks for r in rows]))
    by_rank = np.concatenate([r.labels for r in rows])[order]
    assert [shards.names[i] for i in by_rank] == [dict(labels.collect())[i] for i in ids]


@pytest.mark.parametrize("classes", [3, 300])
def test_naive_bayes_shuffles_no_row_per_class(spark, classes):
    df = spark.createDataFrame([(i, f"w{i % classes} w{i % 7} common", i % classes) for i in range(2 * classes)], "id int, text string, label int")
    terms = materialise(vectorize.count_terms(df, "id", "text"), "terms")
    model = nb_fit(terms, df.select("id", "label"))
    assert {len(r.parts) for r in model.terms.collect()} == {classes} and model.classes.count() == classes
    found = nb_predict(terms, model, df.select("id"))
    rows = weights(terms)
    wanted = brute_naive_bayes([(r.label, rows[r.id]) for r in df.collect()], [rows[i] for i in range(2 * classes)], {t for r in rows.values() for t in r})
    assert {r.id: r.prediction for r in found.collect()} == dict(enumerate(wanted))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("vectorizer", ["Count", "TF-IDF"])
def test_what_travels_of_a_model_does_not_change_its_predictions(spark, topics, monkeypatch, vectorizer):
    rows = [(1000, None, 1), (1001, "", 2), (1002, "unknown words only", 3), (1003, "goal goal goal minister today", 2)]
    df = topics.unionByName(spark.createDataFrame(rows, topics.schema))
    model = workflow.fit_model(workflow.prepare_training(df, "id"), ModelConfig("Naive Bayes", vectorizer))
    terms = vectorize.vectorize(df, "id", "text", vectorizer, model.vocabulary, 0)
    wanted = dict(nb_predict(terms, model.tables, df.select("id")).collect())
    whole = model.predict(materialise(df, "texts"), "id", "text")
    assert "Exchange hash" not in _plan(whole) and "Join" not in _plan(whole)
    for bound in (joins.BROADCAST_BYTES, 600, 0):
        monkeypatch.setattr(joins, "BROADCAST_BYTES", bound)
        assert dict(model.predict(df, "id", "text").collect()) == wanted
    monkeypatch.setattr("wordloom.operators.naive_bayes.COLUMNS", 0)
    assert dict(model.predict(df, "id", "text").collect()) == wanted


@pytest.mark.parametrize("bound", [64_000_000, 600, 0])
def test_unique_texts_are_weighed_inside_the_row(spark, topics, monkeypatch, bound):
    df = topics.unionByName(spark.createDataFrame([(1000, None, 1), (1001, "unknown goal goal", 2)], topics.schema))
    vocabulary = vectorize.fit_vocabulary(topics, "id", "text")
    wanted = weights(vectorize.apply_vectorizer(df, "id", "text", vocabulary))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", bound)
    found = vectorize.weigh_unique(df, "id", "text", vocabulary, ["category"])
    assert found.columns == ["id", "category", "term", "weight"]
    found = weights(found.drop("category"))
    assert found.keys() == wanted.keys() and all(found[i] == pytest.approx(wanted[i]) for i in wanted)
    if bound > 600:
        plan = _plan(vectorize.weigh_unique(topics, "id", "text", vocabulary))
        assert "Exchange" not in plan


def test_naive_bayes_makes_its_facts_once(spark, topics):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    terms = vectorize.count_terms(topics, "id", "text")
    facts = terms.mapInArrow(counted, terms.schema)
    nb_fit(facts, topics.select("id", F.col("category").alias("label")), vectorize.fit_vocabulary(topics, "id", "text").select("term"))
    assert made.value == terms.count()


def test_tfidf_sorts_no_facts(spark, topics):
    plan = vectorize.tfidf(topics, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize(
    "algorithm, vectorizer",
    [
        ("Naive Bayes", "TF-IDF"),
        ("Naive Bayes", "Hashing"),
        ("KNN", "Hashing"),
        ("SVM", "TF-IDF"),
        ("Logistic Regression", "Hashing"),
        ("Decision Tree", "Count"),
    ],
)
def test_training(spark, topics, algorithm, vectorizer):
    config = ModelConfig(algorithm, vectorizer, hash_buckets=256, max_depth=5, test_size=0.25)
    model, report = workflow.train_model(topics, "id", config)
    rows = {r.label: r for r in report.collect()}
    assert rows["accuracy"].support == 15 and rows["accuracy"].f1 >= 0.8
    predicted = model.predict(topics, "id", "text")
    assert predicted.count() == 60 and {r.prediction for r in predicted.collect()} <= {1, 2, 3}


@pytest.mark.parametrize(
    "config",
    [
        ModelConfig("Gradient Boosting", "Count", rounds=2),
        ModelConfig("Random Forest", n_estimators=10, max_depth=5, hash_buckets=16),
    ],
)
def test_forests(spark, topics, config):
    _, report = workflow.train_model(topics, "id", config)
    assert report.where("label = 'accuracy'").first().f1 >= 0.75


@pytest.mark.parametrize("algorithm, vectorizer", [("Decision Tree", "Count"), ("Random Forest", "TF-IDF"), ("SVM", "TF-IDF")])
def test_features_do_not_depend_on_the_number_of_terms(spark, algorithm, vectorizer):
    stages = []
    for words in (5, TREE_BUCKETS - 10, TREE_BUCKETS + 500):
        df = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(words)))], "id int, text string")
        found = fit_vectorizer(df, "text", ModelConfig(algorithm, vectorizer))
        stages.append([type(s).__name__ for s in found.stages])
        size = found.transform(df).first()["features"].size
        assert size == (TREE_BUCKETS if algorithm != "SVM" else words)
    assert stages[0] == stages[1] == stages[2]


@pytest.mark.parametrize(
    "algorithm", ["SVM", "Random Forest", "Logistic Regression", "Naive Bayes", "Decision Tree", "KNN", "Gradient Boosting"]
)
def test_null_texts_in_training(spark, topics, algorithm):
    with_null = topics.where("id % 4 = 0").unionByName(spark.createDataFrame([(1, None, 1), (2, None, 2)], topics.schema))
    config = ModelConfig(algorithm, "Hashing", hash_buckets=64, n_estimators=2, rounds=1, max_depth=2)
    model = workflow.fit_model(workflow.prepare_training(with_null, "id"), config)
    assert model.predict(with_null, "id", "text").count() == with_null.count()


@pytest.mark.parametrize("algorithm", ["KNN", "SVM", "Random Forest", "Decision Tree", "Logistic Regression", "Gradient Boosting"])
def test_all_training_rows_are_learned_from(spark, monkeypatch, algorithm):
    rows = spark.range(0, 200_500, 1, 8).select("id", F.lit("a b").alias("text"), (F.col("id") % 2).alias("label"), F.lit(False).alias("is_test"))
    seen = {}

    def keep(*frames):
        seen.update({name: df.count() for name, df in zip(("scope", "train"), frames)})

    monkeypatch.setattr(workflow, "fit_pipeline", lambda scope, train, *rest: keep(scope, train))
    monkeypatch.setattr(workflow, "_fit_logistic", lambda data, config, scope, train: keep(scope, train))
    config = next(c for c in REGISTERED if c.algorithm == algorithm)
    model = workflow.fit_model(workflow.Prepared(rows, "id", "text", models.Cleaning()), config)
    if algorithm == "KNN":
        seen = {"scope": 200_500, "train": model.labels.count()}
    assert seen == {"scope": 200_500, "train": 200_500}


def test_training_rows_are_bounded_by_a_hash(spark):
    df = spark.range(20_000)
    assert dataset.draw(df, "id", 30_000) is df
    drawn = dataset.draw(df, "id", 5_000)
    assert 4_700 < drawn.count() < 5_300 and drawn.exceptAll(dataset.draw(df, "id", 5_000)).isEmpty()


def test_term_that_is_hot_only_in_the_scored_table(spark, topics, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "HOT_SHARE", 10)
    model = workflow.fit_model(workflow.prepare_training(topics, "id"), ModelConfig("Naive Bayes", "Count"))
    many = spark.range(300).select("id", F.lit("bank").alias("text"))
    assert {r.prediction for r in model.predict(many, "id", "text").collect()} == {3}


def test_train_and_save(spark, topics, tmp_path):
    config = ModelConfig("Naive Bayes", "Count")
    paths = [workflow.train_and_save(topics, "id", str(tmp_path), config)[0] for _ in range(2)]
    assert len(set(paths)) == 2
    model = models.load_model(spark, paths[0])
    assert model.cleaning.lexicon.count() > 0 and model.cleaning.lang == "en"
    one = spark.createDataFrame([(1, "the goals")], "id int, text string")
    assert workflow.predict_class(one, "id", "text", model).first().predicted_class == "2"
    assert models.accept_model(spark, paths[0], "yes") and not models.accept_model(spark, paths[1], "no")


@pytest.mark.parametrize("algorithm", ["SVM", "Logistic Regression", "Decision Tree", "Random Forest", "Gradient Boosting"])
def test_golden_predictions(spark, topics, algorithm):
    """The topics share no word but fillers, so every classifier has to tell them apart, by its settings and no others."""
    config = ModelConfig(algorithm, "Count", n_estimators=30, max_depth=12, rounds=8, hash_buckets=256)
    pipeline = fit_pipeline(topics, topics, "text", "category", config)
    found = models.PipelineTextModel(pipeline, "text", "int").predict(topics, "id", "text")
    wrong = [r.id for r in found.collect() if r.prediction != r.id // 100]
    assert wrong == []
    fitted = pipeline.stages[-2]
    if algorithm == "Random Forest":
        assert fitted.getNumTrees == 30 and max(t.depth for t in fitted.trees) <= 12
    elif algorithm == "Decision Tree":
        assert 4 <= fitted.depth <= 12
    elif algorithm == "Gradient Boosting":
        assert [len(m.trees) for m in fitted.models] == [8, 8, 8]
    elif algorithm == "Logistic Regression":
        assert fitted.numClasses == 3 and fitted.getRegParam() == pytest.approx(1 / 60)


@pytest.mark.parametrize("classes, vectorizer", [(3, "TF-IDF"), (2, "Count"), (1, "TF-IDF")])
def test_logistic_regression_is_that_of_mllib(spark, topics, tmp_path, classes, vectorizer):
    """Coefficients stay in a table, and are those of MLlib up to its tolerance."""
    rows = topics.withColumn("text", F.concat_ws(" ", "text", F.concat(F.lit("own"), "id"))).where(F.col("category") <= classes)
    data = workflow.prepare_training(rows, "id")
    config = ModelConfig("Logistic Regression", vectorizer, c=5.0)
    model = workflow.fit_model(data, config)
    assert isinstance(model, models.LogisticTextModel)
    path = models.save_model(spark, model, str(tmp_path), "Logistic Regression")
    predicted = dict(map(tuple, models.load_model(spark, path).predict(rows, "id", "text").collect()))
    assert sum(predicted[r.id] == r.category for r in rows.collect()) == 20 * classes
    if classes == 1:
        return
    train = data.rows.where("NOT is_test")
    pipeline = fit_pipeline(data.rows, train, "text", "label", config)
    names, fitted = pipeline.stages[0].stages[1].vocabulary, pipeline.stages[-2]
    found = {r.term: np.array(r.parts) for r in model.tables.terms.collect()}
    intercepts = np.array([r.log_prior for r in model.tables.classes.orderBy("label").collect()])
    expected, biases = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    if classes == 2:
        found, intercepts = {t: np.diff(parts) for t, parts in found.items()}, np.diff(intercepts)
    assert set(found) <= set(names)
    nothing = np.zeros(len(expected))
    assert np.abs(np.array([found.get(t, nothing) for t in names]).T - expected).max() < 0.02 * np.abs(expected).max()
    assert np.abs((intercepts - intercepts.mean() if classes > 2 else intercepts) - biases).max() < 0.02 * np.abs(expected).max()


def exclusive_or(spark):
    """Two words; texts with just one of them are one class, those with both or none the other."""
    rows = [(i, " ".join(["on"] + ["left"] * (i % 2) + ["right"] * (i // 2 % 2)), str(i % 2 ^ i // 2 % 2)) for i in range(200)]
    return spark.createDataFrame(rows, "id int, text string, label string")


def test_rbf_separates_what_no_line_does(spark, tmp_path):
    df, right = exclusive_or(spark), {}
    for kernel in ("rbf", "linear"):
        config = ModelConfig("SVM", "Count", c=10.0, kernel=kernel, gamma=1.0 if kernel == "rbf" else None, kernel_features=128)
        pipeline = fit_pipeline(df, df, "text", "label", config)
        model = models.PipelineTextModel(pipeline, "text", "string")
        found = df.join(model.predict(df, "id", "text"), "id")
        right[kernel] = found.where("label = prediction").count()
        if kernel == "rbf":
            again = models.load_model(spark, models.save_model(spark, model, str(tmp_path), "SVM"))
            assert again.predict(df, "id", "text").exceptAll(model.predict(df, "id", "text")).isEmpty()
    assert right["rbf"] == 200 and right["linear"] <= 150


def test_fourier_features_are_the_kernel(spark):
    rng = np.random.default_rng(1)
    vectors = [Vectors.sparse(1000, sorted(rng.choice(1000, 5, replace=False).tolist()), rng.random(5).tolist()) for _ in range(12)]
    vectors += [Vectors.dense([0.5] * 4 + [0.0] * 996), Vectors.sparse(1000, [], [])]
    df = spark.createDataFrame([(v,) for v in vectors], ["v"]).coalesce(1)
    stage = kernels.RandomFourierFeatures(inputCol="v", outputCol="z", dimensions=8192, gamma=0.7)
    z = np.array([r.z.toArray() for r in stage.transform(df).collect()])
    dense = np.array([v.toArray() for v in vectors])
    wanted = np.exp(-0.7 * ((dense[:, None] - dense[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - wanted).max() < 0.06
    assert kernels.scaled_gamma(df, "v") == pytest.approx(1 / (1000 * dense.var()))
    assert kernels.scaled_gamma(df.limit(0), "v") == 1.0


def test_a_batch_draws_the_directions_of_a_term_once(monkeypatch):
    monkeypatch.setattr(kernels, "BLOCK", 3)
    monkeypatch.setattr(kernels, "ENTRIES", 4)
    drawn = []

    class Counted(kernels.Directions):
        def rows(self, terms):
            drawn.extend(terms.tolist())
            return super().rows(terms)

    sparse = [{"type": 0, "size": 50, "indices": [i % 7, 10 + i, 40], "values": [1.0, i + 0.5, -2.0]} for i in range(9)]
    odd = [{"type": 0, "size": 50, "indices": [], "values": []}, {"type": 1, "size": None, "indices": None, "values": [0.5, 3.0]}]
    vectors = [*sparse[:4], *odd, *sparse[4:]]
    found = Counted(42, 16, 0.3).projections(kernels.pa.array(vectors, kernels.ARROW))
    assert sorted(drawn) == [*range(7), *range(10, 19), 40]
    for vector, row in zip(vectors, found, strict=True):
        expected = np.zeros(16)
        for term, value in zip(vector["indices"] or range(2), vector["values"]):
            expected += value * 0.3 * np.random.Generator(np.random.Philox(key=[42, term])).standard_normal(16)
        assert row == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize(("n_train", "models"), [(1_000, 4), (100_000, 2), (200_000, 1), (10_000_000, 1)])
def test_copies_of_kernel_features_are_bounded(spark, n_train, models):
    assert build_classifier(ModelConfig("SVM"), n_train).getParallelism() == models
    assert build_classifier(ModelConfig("SVM", kernel="linear"), n_train).getParallelism() == 4


def test_a_forest_keeps_the_node_of_every_row(spark):
    assert build_classifier(ModelConfig("Random Forest"), 1).getCacheNodeIds()


def test_penalty_and_depth():
    assert ModelConfig().algorithm == "SVM" and ModelConfig().vectorizer == "TF-IDF"
    for bad in ({"algorithm": "Perceptron"}, {"vectorizer": "Word2Vec"}, {"test_size": 0}, {"fit_scope": "none"}, {"kernel": "poly"}, {"gamma": 0}):
        with pytest.raises(ValueError):
            ModelConfig(**bad)


def test_estimators(spark):
    logistic = build_classifier(ModelConfig("Logistic Regression", c=2.0), 50)
    assert logistic.getRegParam() == pytest.approx(0.01)
    assert build_classifier(ModelConfig("Decision Tree"), 1).getMaxDepth() == 30
    assert build_classifier(ModelConfig("Random Forest", max_depth=4), 1).getMaxDepth() == 4
    booster = build_classifier(ModelConfig("Gradient Boosting"), 1).getClassifier()
    assert (booster.getMaxIter(), booster.getStepSize(), booster.getMaxDepth()) == (100, 0.1, 3)
    with pytest.raises(ValueError):
        build_classifier(ModelConfig("KNN"), 1)


def test_training_arguments(spark, topics):
    by_fallback = workflow.prepare_training(topics, "id", target="nope")
    assert by_fallback.rows.count() == 60
    with pytest.raises(ValueError, match="empty"):
        workflow.prepare_training(topics.where("id < 0"), "id")
    with pytest.raises(ValueError, match="category"):
        workflow.prepare_training(topics.drop("category"), "id", target="nope")
    balanced = workflow.prepare_training(
        topics.where("category < 3 or id < 305"), "id", balance="balance_distribution"
    )
    assert balanced.rows.count() == 15


def test_fit_scope_train_knows_training_words_only(spark, topics):
    data = workflow.prepare_training(topics, "id")
    for scope in ("all", "train"):
        model = workflow.fit_model(data, ModelConfig("Naive Bayes", "Count", fit_scope=scope))
        rows = data.rows if scope == "all" else data.rows.where("not is_test")
        terms = vectorize.count_terms(rows, "id", "text").select("term").distinct().count()
        assert model.vocabulary.count() == terms


@pytest.mark.parametrize("algorithm", ["Naive Bayes", "KNN", "SVM"])
def test_store(spark, topics, tmp_path, algorithm):
    model, _ = workflow.train_model(topics, "id", ModelConfig(algorithm))
    path = models.save_model(spark, model, str(tmp_path), algorithm)
    assert f"/{algorithm}_" in path
    again = models.load_model(spark, path)
    assert sorted(map(tuple, model.predict(topics, "id", "text").collect())) == sorted(
        map(tuple, again.predict(topics, "id", "text").collect())
    )
    assert models.accept_model(spark, path, "yes")
    with pytest.raises(ValueError):
        models.accept_model(spark, path, "maybe")
    with pytest.raises(ValueError, match="not a model"):
        models.delete_model(spark, str(tmp_path))
    assert not models.accept_model(spark, path, "no")
    models.delete_model(spark, path)
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, path)


def test_selection(spark, topics):
    grid = [ModelConfig(a, v) for a, v in (("Naive Bayes", "Count"), ("Naive Bayes", "TF-IDF"), ("KNN", "TF-IDF"), ("Decision Tree", "Hashing"))]
    rows = workflow.select_model(topics, "id", grid).collect()
    assert [(r.algorithm, r.vectorizer) for r in rows] == [(c.algorithm, c.vectorizer) for c in grid]
    assert sum(r.best for r in rows) == 1
    data = workflow.prepare_training(topics, "id")
    for config, row in zip(grid[:3], rows):  # what is shared changes no result
        alone = workflow.score_test_rows(data, workflow.fit_model(data, config))
        assert row.accuracy == pytest.approx(alone.where("label = prediction").count() / alone.count())
    assert max(rows, key=lambda r: r.accuracy).accuracy == next(r.accuracy for r in rows if r.best)
    with pytest.raises(ValueError):
        workflow.select_model(topics, "id", [])


@pytest.fixture(scope="module")
def naive(spark, topics):
    return workflow.train_model(topics, "id", ModelConfig("Naive Bayes", "Count"))[0]


def test_class_names(spark, topics, naive):
    df = spark.createDataFrame([(1, "Goal! The team's coach"), (2, None), (3, "bank profit")], "id bigint, text string")
    out = workflow.predict_class(df, "id", "text", naive, {2: "Sports"}).collect()
    assert {r.id: r.predicted_class for r in out} == {1: "Sports", 2: None, 3: UNKNOWN_CLASS}
    plain = workflow.predict_class(df, "id", "text", naive).collect()
    assert {r.id: r.predicted_class for r in plain} == {1: "2", 2: None, 3: "3"}
    assert LABEL_MAPS["en"].get(7) is None


def cells(spark):
    rows = [
        ("a", "the team and the coach of the team in the stadium"),
        ("b", "elle marchait dans le jardin et regardait les fleurs"),
        ("c", "akşamları iyi bir kitap ve bir bardak çaydan daha güzel bir şey yoktur"),
        ("d", "42"),
        ("e", None),
        ("f", "  "),
    ]
    return spark.createDataFrame(rows, "id string, text string").withColumn("copy", F.col("text"))


def test_classify_table(spark, naive, profiles):
    both = {"en": (naive, LABEL_MAPS["en"])}
    out = workflow.classify_table(cells(spark), "id", ["text", "copy"], both, profiles)
    assert out.columns == ["id", "text", "copy", "text_class", "copy_class"]
    rows = {r.id: r.text_class for r in out.collect()}
    assert rows == {
        "a": "Sports",
        "b": UNSUPPORTED_LANGUAGE,
        "c": PREDICTION_ERROR,
        "d": UNSUPPORTED_LANGUAGE,
        "e": None,
        "f": UNSUPPORTED_LANGUAGE,
    }
    assert all(r.text_class == r.copy_class for r in out.collect())


def test_predict_table_takes_any_language(spark, naive, profiles):
    for by in (None, profiles):
        out = workflow.predict_table(cells(spark), "id", ["text"], naive, by)
        rows = {r.id: r.text_class for r in out.collect()}
        assert rows["a"] == "2" and rows["e"] is None
        assert all(rows[i] in {"1", "2", "3"} for i in "bcdf")


def test_process_and_classify(spark, naive, profiles):
    options = CleanOptions(convert_to_uppercase=True, classify_text=True)
    both = {"en": (naive, LABEL_MAPS["en"])}
    out = workflow.process_and_classify(cells(spark), "id", "text", options, both, profiles)
    rows = {r.id: r for r in out.collect()}
    assert len(rows) == 6
    assert rows["a"].processed_text.startswith("THE TEAM") and rows["a"].classification_result == "Sports"
    assert rows["a"].language_detected == "en" and rows["a"].error is None
    assert '"fr"' in rows["b"].error and rows["b"].processed_text is None
    assert rows["c"].classification_result == PREDICTION_ERROR
    assert rows["d"].error and rows["d"].language_detected is None
    assert rows["e"].error == rows["f"].error == ENTER_TEXT
    only_clean = workflow.process_and_classify(
        cells(spark), "id", "text", CleanOptions(convert_to_uppercase=True), both, profiles
    )
    rows = {r.id: r for r in only_clean.collect()}
    assert rows["b"].processed_text.startswith("ELLE") and rows["b"].classification_result is None
    with pytest.raises(ValueError):
        workflow.process_and_classify(cells(spark), "id", "text", CleanOptions(), both, profiles)
