"""Checks on columns and cells, and the quarantine of failed rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.constants import (
    CLEANING_ERROR,
    DETECTION_ERROR,
    ENTER_TEXT,
    NO_PREDICTION,
    PREDICTION_ERROR,
)
from wordloom.functions.text import is_blank
from wordloom.options import CleanOptions

OK = "ok"
ERROR_TEXTS = (CLEANING_ERROR, DETECTION_ERROR, PREDICTION_ERROR, NO_PREDICTION)


def check_columns(df: DataFrame, cols: list[str]) -> None:
    if not cols:
        raise ValueError("no column chosen")
    for name in cols:
        if name not in df.columns:
            raise ValueError(f"column {name!r} not found")


def select_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """The chosen columns; an empty choice and an unknown column are errors."""
    check_columns(df, cols)
    return df.select(*[F.col(f"`{name}`") for name in cols])


def validate_rows(df: DataFrame, col: str, options: CleanOptions) -> DataFrame:
    """Add ``status``: ``ok``, or the request to enter a text where the cell is null or blank."""
    options.check()
    check_columns(df, [col])
    return df.withColumn("status", F.when(is_blank(F.col(col)), ENTER_TEXT).otherwise(OK))


def mark_errors(df: DataFrame, col: str) -> DataFrame:
    """Add ``status``: the error text where a job put one in place of a result, else ``ok``."""
    check_columns(df, [col])
    return df.withColumn("status", F.when(F.col(col).isin(*ERROR_TEXTS), F.col(col)).otherwise(OK))


def row_errors(df: DataFrame) -> DataFrame:
    """The rows whose ``status`` is not ``ok``."""
    check_columns(df, ["status"])
    return df.where(F.col("status") != OK)


def text_cells(df: DataFrame, cols: list[str], null_text: str | None = None) -> DataFrame:
    """Cast the chosen columns to text. Null stays null unless ``null_text`` names a stand-in."""
    check_columns(df, cols)
    cells = {name: F.col(f"`{name}`").cast("string") for name in cols}
    if null_text is not None:
        cells = {name: F.coalesce(cell, F.lit(null_text)) for name, cell in cells.items()}
    return df.withColumns(cells)
