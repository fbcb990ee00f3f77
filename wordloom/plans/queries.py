"""One registered query per job, over whole tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.constants import CLEANING_ERROR, DETECTION_ERROR, LABEL_MAPS, NO_PREDICTION, PREDICTION_ERROR
from wordloom.functions import text as T
from wordloom.functions.stopwords import stopword_lists
from wordloom.operators import dataset, evaluate, language, morphology, validate, vectorize
from wordloom.operators.clean import clean_column, clean_text, process_table
from wordloom.options import PRESET, CleanOptions, ModelConfig
from wordloom.plans import models, workflow
from wordloom.sources.scratch import materialise, scratch_path
from wordloom.sources.sinks import PROCESSED, write_result
from wordloom.sources.tables import load_training, read_table, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# The test tables hold no Turkish; French stands in as the second supported language.
LANGUAGES = ("en", "fr")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "text")


def _category() -> Column:
    """An integer class from 1 to 7 out of the source number; the English label map ends at 6."""
    return (F.substring("source", 4, 10).cast("int") % 7 + 1).alias("category")


def _digits() -> Column:
    """The digits of a text: blank for texts without any."""
    return F.regexp_replace("text", "[^0-9]+", " ")


def _profiles(docs: DataFrame) -> DataFrame:
    return materialise(language.language_profiles(docs, "text", "lang"), "profiles")


def _lexicon(docs: DataFrame) -> DataFrame:
    """The lexicon of the scoring queries: lowercase words of the raw texts, without punctuation."""
    plain = docs.select(T.to_lower(T.remove_special_chars(T.remove_punctuation(F.col("text")))).alias("text"))
    return materialise(morphology.corpus_lexicon(plain, "text"), "lexicon")


# Sources and sinks


@query
def csv_source(spark, sf_dir):
    path = write_result(documents(spark, sf_dir), scratch_path(spark, "documents"), PROCESSED)
    return read_table(spark, path, DOCUMENT_SCHEMA)


@query
def load_training_data(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return load_training(spark, "en", docs.select(F.col("doc_id").alias("id"), "text", _category(), "lang"))


@query
def csv_sink(spark, sf_dir):
    cleaned = _texts(spark, sf_dir).withColumn("text", T.to_lower(T.remove_punctuation(F.col("text"))))
    path = write_result(cleaned, scratch_path(spark, "out"), PROCESSED)
    return read_table(spark, path, "doc_id bigint, text string")


@query
def model_store(spark, sf_dir):
    docs = documents(spark, sf_dir)
    data = workflow.prepare_training(docs, "doc_id", "lang")
    config = ModelConfig(algorithm="Naive Bayes", vectorizer="Count")
    path = models.save_model(spark, workflow.fit_model(data, config), scratch_path(spark, "models"), "Naive Bayes")
    return workflow.score_test_rows(data, models.load_model(spark, path))


# Projections, filters, validation


@query
def select_columns(spark, sf_dir):
    return validate.select_columns(documents(spark, sf_dir), ["doc_id", "lang", "source"])


@query
def process_table_query(spark, sf_dir):
    docs = documents(spark, sf_dir)
    options = CleanOptions(
        remove_punctuation=True, remove_special_chars=True, convert_to_lowercase=True, remove_stopwords=True
    )
    return process_table(docs, "doc_id", ["text"], options, _profiles(docs))


@query
def validate_rows(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", _digits().alias("digits"))
    return validate.validate_rows(docs, "digits", PRESET)


def _with_sentinels() -> Column:
    """The digits of a text, and in place of blank ones the four texts that stand for a failure, by language."""
    failed = F.when(F.col("lang") == "en", CLEANING_ERROR).when(F.col("lang") == "fr", DETECTION_ERROR)
    failed = failed.when(F.col("lang") == "de", PREDICTION_ERROR).otherwise(NO_PREDICTION)
    return F.when(F.trim(_digits()) == "", failed).otherwise(_digits())


@query
def row_errors(spark, sf_dir):
    results = documents(spark, sf_dir).select("doc_id", _with_sentinels().alias("result"))
    return validate.row_errors(validate.mark_errors(results, "result"))


@query
def null_cells(spark, sf_dir):
    labels = load(spark, sf_dir, "labels")
    docs = documents(spark, sf_dir).select("doc_id").join(labels, "doc_id", "left")
    return validate.text_cells(docs, ["quality", "toxic"], null_text="nan")


# Text transforms


def _scalar(change: Callable[[Column], Column]) -> Query:
    def run(spark, sf_dir):
        return _texts(spark, sf_dir).withColumn("text", change(F.col("text")))

    return run


QUERIES["remove_punctuation"] = _scalar(T.remove_punctuation)
QUERIES["remove_special_chars"] = _scalar(T.remove_special_chars)
QUERIES["convert_to_lowercase"] = _scalar(T.to_lower)
QUERIES["convert_to_uppercase"] = _scalar(T.to_upper)


@query
def remove_stopwords(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", T.remove_stopwords(F.col("text"), F.col("lang"), stopword_lists()).alias("text"))


QUERIES["valid_word_filter"] = _scalar(lambda c: T.join_words(T.valid_words(c)))


@query
def stemming(spark, sf_dir):
    return morphology.stem(_texts(spark, sf_dir), "doc_id", "text")


@query
def lemmatization(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    return morphology.lemmatize(texts, "doc_id", "text", materialise(morphology.corpus_lexicon(texts, "text"), "lexicon"))


@query
def clean_text_query(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    plain = texts.select(clean_column(F.col("text"), PRESET).alias("text"))
    lexicon = materialise(morphology.corpus_lexicon(plain, "text"), "lexicon")
    return clean_text(texts, "doc_id", "text", PRESET, lexicon=lexicon)


# Languages


@query
def detect_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return language.detect_language(docs, "doc_id", "text", _profiles(docs))


@query
def language_profiles(spark, sf_dir):
    return language.language_profiles(documents(spark, sf_dir), "text", "lang")


@query
def language_gate(spark, sf_dir):
    return language.language_gate(documents(spark, sf_dir).select("doc_id", "lang"), "lang", LANGUAGES)


# Dataset preparation


@query
def class_distribution(spark, sf_dir):
    return dataset.class_distribution(load(spark, sf_dir, "events"), "event_type")


@query
def remove_low_classes(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", "event_type")
    return dataset.remove_low_classes(events, "event_type")


@query
def balance_distribution(spark, sf_dir):
    return dataset.balance(documents(spark, sf_dir), "doc_id", "lang")


@query
def train_test_split(spark, sf_dir):
    return dataset.split(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id")


# Vectorizers


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("weight", F.round("weight", 6))


@query
def vectorize_count(spark, sf_dir):
    return vectorize.count_terms(_texts(spark, sf_dir), "doc_id", "text")


@query
def vectorize_tfidf(spark, sf_dir):
    return _rounded(vectorize.tfidf(_texts(spark, sf_dir), "doc_id", "text"))


@query
def vectorize_hashing(spark, sf_dir):
    return _rounded(vectorize.hashed(_texts(spark, sf_dir), "doc_id", "text"))


@query
def vectorizer_transform(spark, sf_dir):
    vocabulary = vectorize.fit_vocabulary(_texts(spark, sf_dir), "doc_id", "text")
    talks = load(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "text")
    return _rounded(vectorize.apply_vectorizer(talks, "turn_id", "text", vocabulary))


# Classifiers: the language of a document from its words


def _classify(config: ModelConfig) -> Query:
    def run(spark, sf_dir):
        data = workflow.prepare_training(documents(spark, sf_dir), "doc_id", "lang")
        return workflow.score_test_rows(data, workflow.fit_model(data, config))

    return run


def _fitted(config: ModelConfig, floor: float = 0.8) -> Query:
    """One row: the test rows, how many predictions are no known class, and whether the accuracy reaches a floor.

    The fit itself differs from engine to engine; ``classified`` gives its predictions.
    """

    def run(spark, sf_dir):
        scored = materialise(classified(spark, sf_dir, config), "scored")
        known = scored.select(F.col("label").alias("prediction")).distinct()
        strange = scored.join(known, "prediction", "left_anti").count()
        return scored.agg(
            F.count("*").alias("test_rows"),
            F.lit(strange).cast("bigint").alias("unknown_predictions"),
            (F.avg((F.col("label") == F.col("prediction")).cast("double")) >= floor).alias("accurate"),
        )

    return run


def classified(spark: SparkSession, sf_dir: str, config: ModelConfig) -> DataFrame:
    """``(doc_id, label, prediction)`` of the test rows."""
    return _classify(config)(spark, sf_dir)


QUERIES["classify_svm"] = _fitted(ModelConfig("SVM"))
QUERIES["classify_random_forest"] = _fitted(ModelConfig("Random Forest"))
QUERIES["classify_logistic"] = _fitted(ModelConfig("Logistic Regression"))
QUERIES["classify_naive_bayes"] = _classify(ModelConfig("Naive Bayes", "Count"))
QUERIES["classify_decision_tree"] = _fitted(ModelConfig("Decision Tree"))
QUERIES["classify_knn"] = _classify(ModelConfig("KNN"))
QUERIES["classify_gradient_boosting"] = _fitted(ModelConfig("Gradient Boosting"))


# Evaluation and model workflow


@query
def accuracy(spark, sf_dir):
    labels = load(spark, sf_dir, "labels").withColumn("guess", 1 - F.col("toxic"))
    return evaluate.accuracy(labels, "quality", "guess").withColumn("accuracy", F.round("accuracy", 6))


def _rounded_report(report: DataFrame) -> DataFrame:
    return report.withColumns({name: F.round(name, 6) for name in ("precision", "recall", "f1")})


@query
def classification_report(spark, sf_dir):
    guess = (
        F.when(F.col("text").contains(" the "), "en")
        .when(F.col("text").contains(" le "), "fr")
        .when(F.col("text").contains(" und "), "de")
        .otherwise("es")
    )
    docs = documents(spark, sf_dir).select("lang", guess.alias("guess"))
    return _rounded_report(evaluate.classification_report(docs, "lang", "guess"))


@query
def train_model(spark, sf_dir):
    config = ModelConfig("Naive Bayes", "TF-IDF")
    _, report = workflow.train_model(documents(spark, sf_dir), "doc_id", config, target="lang")
    return _rounded_report(report)


@query
def model_selection(spark, sf_dir):
    grid = [
        ModelConfig("Naive Bayes", "Count"),
        ModelConfig("Naive Bayes", "TF-IDF"),
        ModelConfig("Naive Bayes", "Hashing"),
        ModelConfig("KNN", "TF-IDF"),
    ]
    found = workflow.select_model(documents(spark, sf_dir), "doc_id", grid, target="lang")
    return found.withColumn("accuracy", F.round("accuracy", 6))


# Scoring


def _fit_category(docs: DataFrame, lexicon: DataFrame, clean_language: str = "en"):
    data = workflow.prepare_training(
        docs.select("doc_id", "text", _category()), "doc_id", lexicon=lexicon, clean_language=clean_language
    )
    return workflow.fit_model(data, ModelConfig("Naive Bayes", "Count"))


def _models(docs: DataFrame, lexicon: DataFrame):
    """A model per language: English classes have names, the other language keeps its numbers."""
    return {
        "en": (_fit_category(docs.where("lang = 'en'"), lexicon), LABEL_MAPS["en"]),
        "fr": (_fit_category(docs.where("lang = 'fr'"), lexicon, "fr"), None),
    }


@query
def predict_class(spark, sf_dir):
    docs = documents(spark, sf_dir)
    lexicon = _lexicon(docs)
    model = _fit_category(docs, lexicon)
    return workflow.predict_class(docs, "doc_id", "text", model, LABEL_MAPS["en"], lexicon=lexicon)


@query
def classify_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    lexicon = _lexicon(docs)
    table = docs.select("doc_id", "source", "text")
    classified = workflow.classify_table(
        table, "doc_id", ["text"], _models(docs, lexicon), _profiles(docs), LANGUAGES, lexicon
    )
    return classified.drop("text")


@query
def predict_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    lexicon = _lexicon(docs)
    data = workflow.prepare_training(docs, "doc_id", "lang", lexicon=lexicon)
    model = workflow.fit_model(data, ModelConfig("Naive Bayes", "Count"))
    table = docs.select("doc_id", "source", "text")
    scored = workflow.predict_table(table, "doc_id", ["text"], model, _profiles(docs), lexicon=lexicon)
    return scored.drop("text")


@query
def process_and_classify(spark, sf_dir):
    docs = documents(spark, sf_dir)
    lexicon = _lexicon(docs)
    options = CleanOptions(
        remove_punctuation=True, convert_to_uppercase=True, remove_stopwords=True, classify_text=True
    )
    return workflow.process_and_classify(
        docs, "doc_id", "text", options, _models(docs, lexicon), _profiles(docs), LANGUAGES, lexicon
    )


# Two jobs share their name with an imported operator.
QUERIES["process_table"] = QUERIES.pop("process_table_query")
QUERIES["clean_text"] = QUERIES.pop("clean_text_query")
