"""Training, model selection and scoring of tables."""

from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.constants import (
    CLEANING_FAILED,
    DETECTION_FAILED,
    ENTER_TEXT,
    LANGUAGE_NOT_SUPPORTED,
    NO_PREDICTION,
    PREDICTION_ERROR,
    SUPPORTED,
    UNKNOWN_CLASS,
    UNSUPPORTED_LANGUAGE,
)
from wordloom.functions.text import is_blank
from wordloom.operators.clean import clean_column, clean_text
from wordloom.operators.dataset import balance_action, split
from wordloom.operators.evaluate import accuracy, classification_report
from wordloom.operators.joins import check_ids, with_row_id
from wordloom.operators.knn import knn_fit, knn_score, packed_vectors
from wordloom.operators.language import language_of
from wordloom.operators.logistic import logistic_fit, numbered_texts
from wordloom.operators.mllib import fit_pipeline
from wordloom.operators.morphology import corpus_lexicon, lemmatize_numbered
from wordloom.operators.naive_bayes import nb_fit, nb_predict
from wordloom.operators.validate import check_columns, text_cells
from wordloom.operators.vectorize import count_terms, fit_vocabulary, term_counts, vectorize
from wordloom.options import PRESET, CleanOptions, ModelConfig
from wordloom.plans.models import Cleaning, KnnTextModel, LogisticTextModel, NaiveBayesTextModel, PipelineTextModel, TextModel, save_model
from wordloom.sources.scratch import materialise

FALLBACK_TARGET = "category"
# Names the folder of texts in languages without a model.
OTHER = "-"


@dataclass(frozen=True)
class Prepared:
    """Cleaned and split rows ``(id, label, text, is_test)``, written once for any number of models, and how they were cleaned."""

    rows: DataFrame
    id: str
    text: str
    cleaning: Cleaning


def prepare_training(
    df: DataFrame,
    id: str,
    target: str = FALLBACK_TARGET,
    text: str = "text",
    balance: str = "use_as_is",
    test_size: float = 0.2,
    seed: int = 42,
    lexicon: DataFrame | None = None,
    clean_language: str = "en",
    exceptions: DataFrame | None = None,
    lists=None,
) -> Prepared:
    """Balance, clean with the preset, and split. A target the table lacks falls back to ``category``.

    Rows without a class are left out; ids must be unique and not null. Without ``lexicon`` the training table gives one,
    which goes with the model: texts to score are lemmatized by it, whatever stands beside them.
    """
    if target not in df.columns:
        target = FALLBACK_TARGET
    check_columns(df, [id, text, target])
    rows = df.where(F.col(target).isNotNull()).select(id, F.col(target).alias("label"), text)
    check_ids(rows, id)
    rows = balance_action(rows, id, "label", balance, seed)
    # The split looks at ids only, so it is decided before the costly cleaning.
    marked = split(rows, id, test_size, seed)
    # As ``clean_text`` does it, but the text without its lemmas is written once for the lexicon and the lemmas.
    row = "_row"
    while row in marked.columns:
        row += "_"
    plain = with_row_id(marked.withColumn(text, clean_column(F.col(text), PRESET, clean_language, lists)), row)
    if lexicon is None:
        lexicon = materialise(corpus_lexicon(plain, text), "lexicon")
    cleaned = materialise(lemmatize_numbered(plain, row, text, lexicon, exceptions, True).drop(row), "training-rows")
    if cleaned.isEmpty():
        raise ValueError("the training table is empty")
    return Prepared(cleaned, id, text, Cleaning(clean_language, lexicon, exceptions, lists))


def fit_model(data: Prepared, config: ModelConfig) -> TextModel:
    """Fit vectorizer and classifier. The vectorizer sees all rows, or the training rows only (``fit_scope``).

    Every algorithm learns from all training rows.
    """
    rows, id, text = data.rows, data.id, data.text
    train = rows.where(~F.col("is_test"))
    scope = rows if config.fit_scope == "all" else train
    if config.algorithm == "Logistic Regression":
        return _fit_logistic(data, config, scope, train)
    if config.algorithm not in ("Naive Bayes", "KNN"):
        pipeline = fit_pipeline(scope, train, text, "label", config)
        return PipelineTextModel(pipeline, text, rows.schema["label"].dataType.simpleString(), data.cleaning)
    hashing = config.vectorizer == "Hashing"
    vocabulary = None if hashing else fit_vocabulary(scope, id, text)
    keep = ["label"] if config.algorithm == "Naive Bayes" else []
    if config.vectorizer == "Count":
        # The rows to learn from are among those of the vocabulary, which has all their terms.
        terms = count_terms(train, id, text, keep)
    else:
        terms = vectorize(train, id, text, config.vectorizer, vocabulary, config.buckets, keep, unique=True)
    labels = train.select(id, "label")
    if config.algorithm == "KNN":
        stored = materialise(terms, "knn-terms")
        return KnnTextModel(config.vectorizer, config.buckets, vocabulary, stored, labels, config.n_neighbors, data.cleaning)
    if hashing:
        tables = nb_fit(terms, labels, size=config.buckets)
    else:
        tables = nb_fit(terms, labels, vocabulary.select("term"))
    return NaiveBayesTextModel(config.vectorizer, config.buckets, vocabulary, tables, data.cleaning)


def _fit_logistic(data: Prepared, config: ModelConfig, scope: DataFrame, train: DataFrame) -> TextModel:
    """The vocabulary of ``scope`` and coefficients, both tables."""
    texts = numbered_texts(train.select(data.id, "label", data.text))
    vocabulary = None if config.vectorizer == "Hashing" else fit_vocabulary(scope, data.id, data.text)
    terms = vectorize(texts, "_at", data.text, config.vectorizer, vocabulary, config.buckets, unique=True)
    tables = logistic_fit(terms, texts.select("_at", "label"), config.c)
    return LogisticTextModel(config.vectorizer, config.buckets, vocabulary, tables, data.cleaning)


def score_test_rows(data: Prepared, model: TextModel) -> DataFrame:
    """``(id, label, prediction)`` of the held-out rows."""
    test = data.rows.where("is_test")
    return test.select(data.id, "label").join(model.predict(test, data.id, data.text), data.id)


def train_model(
    df: DataFrame,
    id: str,
    config: ModelConfig = ModelConfig(),
    target: str = FALLBACK_TARGET,
    text: str = "text",
    balance: str = "use_as_is",
    lexicon: DataFrame | None = None,
    clean_language: str = "en",
    exceptions: DataFrame | None = None,
) -> tuple[TextModel, DataFrame]:
    """Clean, split, vectorize, fit and evaluate; returns the model and its report.

    The report is that of ``classification_report``, with the accuracy as one of its rows.
    """
    data = prepare_training(
        df, id, target, text, balance, config.test_size, config.random_state, lexicon, clean_language, exceptions
    )
    model = fit_model(data, config)
    # The report reads the pairs twice.
    scored = materialise(score_test_rows(data, model).select("label", "prediction"), "scored")
    return model, classification_report(scored, "label", "prediction")


def train_and_save(df: DataFrame, id: str, folder: str, config: ModelConfig = ModelConfig(), **settings) -> tuple[str, DataFrame]:
    """``train_model``, with the model saved in ``folder``: its path, which ``accept_model`` keeps or deletes, and the report."""
    model, report = train_model(df, id, config, **settings)
    return save_model(df.sparkSession, model, folder, config.algorithm), report


@dataclass(frozen=True)
class Features:
    """The weighted terms of all rows by one vectorizer, written once for every algorithm that works on them."""

    vocabulary: DataFrame | None
    terms: DataFrame


def _features(data: Prepared, config: ModelConfig) -> Features:
    scope = data.rows if config.fit_scope == "all" else data.rows.where(~F.col("is_test"))
    vocabulary = None if config.vectorizer == "Hashing" else fit_vocabulary(scope, data.id, data.text)
    terms = vectorize(data.rows, data.id, data.text, config.vectorizer, vocabulary, config.buckets, ["label", "is_test"], unique=True)
    return Features(vocabulary, materialise(terms, "features"))


def _score_features(data: Prepared, config: ModelConfig, features: Features) -> DataFrame:
    """``score_test_rows(fit_model(...))`` for the two algorithms that work on weighted terms."""
    id, rows = data.id, data.rows
    test = rows.where("is_test").select(id, "label")
    train_terms, test_terms = (features.terms.where(c).select(id, "term", "weight", "label") for c in (~F.col("is_test"), F.col("is_test")))
    labels = rows.where(~F.col("is_test")).select(id, "label")
    if config.algorithm == "KNN":
        indexes = knn_fit(train_terms.drop("label"), labels, config.n_neighbors)
        return knn_score(packed_vectors(test, test_terms.drop("label")), indexes, config.n_neighbors, labels.schema["label"].dataType)
    if config.vectorizer == "Hashing":
        tables = nb_fit(train_terms, labels, size=config.buckets)
    else:
        tables = nb_fit(train_terms, labels, features.vocabulary.select("term"))
    counts = None if features.vocabulary is None else term_counts(features.vocabulary)
    return test.join(nb_predict(test_terms.drop("label"), tables, test.select(id), counts), id)


def select_model(
    df: DataFrame,
    id: str,
    grid: Iterable[ModelConfig],
    target: str = FALLBACK_TARGET,
    text: str = "text",
    lexicon: DataFrame | None = None,
    parallel: int = 4,
) -> DataFrame:
    """``(vectorizer, algorithm, accuracy, best)`` for every configuration, all on one cleaned table and split.

    Naive Bayes and KNN share one written table of weighted terms per vectorizer. ``parallel`` configurations are fitted at a time.
    """
    grid = list(grid)
    if not grid:
        raise ValueError("no configuration to try")
    if len({(c.test_size, c.random_state) for c in grid}) > 1:
        raise ValueError("all configurations must share test_size and random_state")
    first = grid[0]
    data = prepare_training(df, id, target, text, "use_as_is", first.test_size, first.random_state, lexicon)
    shared: dict[tuple, Features] = {}
    for config in grid:
        key = (config.vectorizer, config.buckets, config.fit_scope)
        if config.algorithm in ("Naive Bayes", "KNN") and key not in shared:
            shared[key] = _features(data, config)

    def score(config: ModelConfig) -> float:
        features = shared.get((config.vectorizer, config.buckets, config.fit_scope))
        if config.algorithm in ("Naive Bayes", "KNN"):
            scored = _score_features(data, config, features)
        else:
            scored = score_test_rows(data, fit_model(data, config))
        return accuracy(scored, "label", "prediction").first()["accuracy"]

    with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(grid)))) as pool:
        found = list(pool.map(score, grid))
    best = min(range(len(grid)), key=lambda i: (-(found[i] or 0.0), i))
    rows = [(c.vectorizer, c.algorithm, a, i == best) for i, (c, a) in enumerate(zip(grid, found))]
    return df.sparkSession.createDataFrame(rows, "vectorizer string, algorithm string, accuracy double, best boolean")


def class_name(prediction: Column, label_map: Mapping[int, str] | None) -> Column:
    """The name of a class. Without a map the class is its own name; an id the map lacks is unknown."""
    if label_map is None:
        return prediction.cast("string")
    pairs = [F.lit(part) for pair in label_map.items() for part in pair]
    named = F.coalesce(F.try_element_at(F.create_map(*pairs), prediction.cast("int")), F.lit(UNKNOWN_CLASS))
    return F.when(prediction.isNotNull(), named)


def _plainly_cleaned(c: Column, model: TextModel, lang: str | Column | None) -> Column:
    """The part of the preset that is one expression, with the model's own language and stop words."""
    own = model.cleaning
    return clean_column(c, PRESET, own.lang if lang is None else lang, own.lists)


def _classified(rows: DataFrame, row: str, name: str, model: TextModel, label_map, lexicon=None, exceptions=None) -> DataFrame:
    """``rows`` with a class added. They are written, ``row`` tells them apart, and ``_plain`` is the text but for its lemmas.

    Lemmas and terms of a text leave the table by its number; the classes, a small column, come back by it.
    """
    own = model.cleaning
    present = rows.where(F.col("_plain").isNotNull())
    lexicon, exceptions = own.lexicon if lexicon is None else lexicon, own.exceptions if exceptions is None else exceptions
    cleaned = lemmatize_numbered(present.select(row, "_plain"), row, "_plain", lexicon, exceptions, True)
    found = model.predict(cleaned, row, "_plain", present.select(row)).select(row, F.col("prediction").alias("_prediction"))
    named = F.coalesce(class_name(F.col("_prediction"), label_map), F.lit(PREDICTION_ERROR))
    # Whether there is a text is told before the join, so that texts nobody reads later do not go through it.
    joined = rows.withColumn("_present", F.col("_plain").isNotNull()).join(found.hint("merge"), row, "left")
    return joined.withColumn(name, F.when(F.col("_present"), named)).select(*[F.col(f"`{c}`") for c in rows.columns], name)


def _written(df: DataFrame, plain: Column, partition_by: str | None = None) -> DataFrame:
    """The table with the plainly cleaned text and a number for every row, written: the one copy that a scoring job makes."""
    return materialise(df.withColumn("_plain", plain).withColumn("_row", F.monotonically_increasing_id()), "scored-rows", partition_by)


def predict_class(
    df: DataFrame,
    id: str,
    col: str,
    model: TextModel,
    label_map: Mapping[int, str] | None = None,
    lang: str | Column | None = None,
    lexicon: DataFrame | None = None,
    exceptions: DataFrame | None = None,
) -> DataFrame:
    """``(id, predicted_class)``: clean with the preset, predict, name the class. Null text has no class.

    Language, lexicon and exceptions are those the model was trained with, unless others are given. Ids may be null or repeated.
    """
    check_columns(df, [id, col])
    told = df if lang is None or isinstance(lang, str) else df.withColumn("_lang", lang)
    by = lang if told is df else F.col("_lang")
    plain = _plainly_cleaned(F.col(f"`{col}`").cast("string"), model, by)
    rows = _written(told.select(F.col(f"`{id}`"), plain.alias("_plain")), F.col("_plain"))
    return _classified(rows, "_row", "predicted_class", model, label_map, lexicon, exceptions).select(id, "predicted_class")


def _classify_by_language(
    rows: DataFrame,
    col: str,
    name: str,
    models: Mapping[str, tuple[TextModel, Mapping[int, str] | None]],
    supported,
    lexicon,
) -> DataFrame:
    """``rows``, which have a ``_lang``, with a class added: each language goes to its own model.

    The rows are written once with all their columns, a folder per language, so that each model reads only those it scores.
    """
    text, plain = F.col(f"`{col}`"), F.lit(None).cast("string")
    for code in supported:
        if code in models:
            plain = F.when(F.col("_lang") == code, _plainly_cleaned(text, models[code][0], code)).otherwise(plain)
    route = F.when(F.col("_lang").isin(*supported), F.col("_lang")).otherwise(OTHER)
    routed = _written(rows.withColumn("_route", route), plain, "_route")
    out = routed.where(F.col("_route") == OTHER).withColumn(name, F.when(text.isNotNull(), UNSUPPORTED_LANGUAGE))
    for code in supported:
        own = routed.where(F.col("_route") == code)
        if code in models:
            model, label_map = models[code]
            part = _classified(own, "_row", name, model, label_map, lexicon)
        else:
            part = own.withColumn(name, F.lit(PREDICTION_ERROR))
        out = out.unionByName(part)
    return out.drop("_route", "_row", "_plain")


def classify_table(
    df: DataFrame,
    id: str,
    cols: list[str],
    models: Mapping[str, tuple[TextModel, Mapping[int, str] | None]],
    profiles: DataFrame,
    supported=SUPPORTED,
    lexicon: DataFrame | None = None,
) -> DataFrame:
    """Append ``{col}_class`` for every chosen column.

    Each cell's language is detected; cells outside ``supported`` are named so, the others are cleaned and go to
    the model of their language. ``models`` maps a code to a model and its label map. The table is written once per chosen column
    and nothing is joined back by ``id``.
    """
    check_columns(df, cols)
    out = df
    for name in cols:
        cell = F.col(f"`{name}`").cast("string")
        rows = out.withColumn("_cell", cell).withColumn("_lang", language_of(F.col("_cell"), profiles))
        classified = _classify_by_language(rows, "_cell", f"{name}_class", models, supported, lexicon)
        out = classified.select(*[F.col(f"`{c}`") for c in out.columns], F.col(f"`{name}_class`"))
    return out


def predict_table(
    df: DataFrame,
    id: str,
    cols: list[str],
    model: TextModel,
    profiles: DataFrame | None = None,
    lang: str | None = None,
    lexicon: DataFrame | None = None,
) -> DataFrame:
    """Append ``{col}_class`` by one own model, whatever the language; classes keep the names they were given.

    Each cell is cleaned by its detected language when ``profiles`` are given, else by ``lang`` or the model's own.
    """
    check_columns(df, cols)
    out = df
    for name in cols:
        rows, by = out.withColumn("_cell", F.col(f"`{name}`").cast("string")), lang
        if profiles is not None:
            # A column of its own: detected once per row, not once per word.
            rows, by = rows.withColumn("_lang", language_of(F.col("_cell"), profiles)), F.col("_lang")
        rows = _written(rows, _plainly_cleaned(F.col("_cell"), model, by))
        classified = _classified(rows, "_row", f"{name}_class", model, None, lexicon)
        out = classified.select(*[F.col(f"`{c}`") for c in out.columns], F.col(f"`{name}_class`"))
    return out


def process_and_classify(
    df: DataFrame,
    id: str,
    col: str,
    options: CleanOptions,
    models: Mapping[str, tuple[TextModel, Mapping[int, str] | None]],
    profiles: DataFrame,
    supported=SUPPORTED,
    lexicon: DataFrame | None = None,
) -> DataFrame:
    """``(id, processed_text, classification_result, language_detected, error)`` for every row.

    Cleaning follows ``options``; the classifier gets the raw text through its own preset. A row with an error
    has no other result. ``lexicon`` is for lemmatization among the options, and overrides the models' own.
    """
    options.check()
    check_columns(df, [id, col])
    cells = text_cells(df.select(id, col), [col])
    rows = cells.withColumn("_lang", language_of(F.col(f"`{col}`"), profiles)).withColumn("_raw", F.col(f"`{col}`"))
    out = clean_text(rows, id, col, options, F.col("_lang"), lexicon=lexicon)
    error = F.when(is_blank(F.col("_raw")), ENTER_TEXT).when(F.col("_lang").isNull(), DETECTION_FAILED)
    error = error.when(F.col(f"`{col}`").isNull(), CLEANING_FAILED)
    result = F.lit(None).cast("string")
    if options.classify_text:
        error = error.when(~F.col("_lang").isin(*supported), F.format_string(LANGUAGE_NOT_SUPPORTED, "_lang"))
        out = _classify_by_language(out, "_raw", "_class", models, supported, lexicon)
        result = F.coalesce("_class", F.lit(NO_PREDICTION))
    fine = F.col("error").isNull()
    return out.withColumn("error", error).select(
        id,
        F.when(fine, F.col(f"`{col}`")).alias("processed_text"),
        F.when(fine, result).alias("classification_result"),
        F.when(fine, F.col("_lang")).alias("language_detected"),
        "error",
    )
