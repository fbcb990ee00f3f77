"""The cleaning job: up to seven transforms in one fixed order."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.constants import PUNCTUATION, SPECIAL_CHARS
from wordloom.functions import text as T
from wordloom.functions.stopwords import stopword_lists
from wordloom.operators.language import language_of
from wordloom.operators.morphology import lemmatize, stem
from wordloom.operators.validate import check_columns, text_cells
from wordloom.options import CleanOptions


def clean_column(c: Column, options: CleanOptions, lang: str | Column = "en", lists=None) -> Column:
    """The part of cleaning that is one expression: punctuation, special characters, case, stop words."""
    if options.remove_punctuation and options.remove_special_chars:
        c = T.without(c, PUNCTUATION + SPECIAL_CHARS)
    elif options.remove_punctuation:
        c = T.remove_punctuation(c)
    elif options.remove_special_chars:
        c = T.remove_special_chars(c)
    if options.convert_to_lowercase:
        c = T.to_lower(c)
    if options.convert_to_uppercase:
        c = T.to_upper(c)
    if options.remove_stopwords:
        c = T.remove_stopwords(c, lang, stopword_lists() if lists is None else lists)
    return c


def clean_text(
    df: DataFrame,
    id: str,
    col: str,
    options: CleanOptions,
    lang: str | Column = "en",
    lists=None,
    lexicon: DataFrame | None = None,
    exceptions: DataFrame | None = None,
) -> DataFrame:
    """Clean column ``col`` in place. Later steps see the result of earlier ones; null stays null."""
    check_columns(df, [id, col])
    out = df.withColumn(col, clean_column(F.col(col), options, lang, lists))
    if options.stemming:
        out = stem(out, id, col, options.extended_stemmer)
    if options.lemmatization:
        if lexicon is None:
            raise ValueError("lemmatization needs a lexicon; corpus_lexicon makes one from a corpus")
        out = lemmatize(out, id, col, lexicon, exceptions)
    return out


def process_table(
    df: DataFrame,
    id: str,
    cols: list[str],
    options: CleanOptions,
    profiles: DataFrame,
    lists=None,
    lexicon: DataFrame | None = None,
    exceptions: DataFrame | None = None,
) -> DataFrame:
    """Clean every chosen column in place, each cell by its own language; other columns stay as they are.

    A cell whose language cannot be told keeps its text. Nothing is joined by ``id``, so ids may be null or repeated.
    """
    options.check()
    check_columns(df, cols)
    out = text_cells(df, cols)
    for name in cols:
        known = out.withColumn("_lang", language_of(F.col(f"`{name}`"), profiles)).withColumn("_raw", F.col(f"`{name}`"))
        cleaned = clean_text(known, id, name, options, F.col("_lang"), lists, lexicon, exceptions)
        out = cleaned.withColumn(name, F.when(F.col("_lang").isNull(), F.col("_raw")).otherwise(F.col(f"`{name}`"))).select(
            *[F.col(f"`{c}`") for c in df.columns]
        )
    return out
