"""Reading user tables and training tables."""

import logging
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.constants import SUPPORTED
from wordloom.sources.csv_records import read_records

log = logging.getLogger(__name__)

TRAINING_SCHEMA = "id bigint, text string, category int"


def read_table(spark: SparkSession, path: str, schema=None, multi_line: bool = True) -> DataFrame:
    """Read a CSV table with a header line; without ``schema`` every column is a string.

    Quoted cells may span lines; a file is read by as many tasks as its size asks for all the same (``sources.csv_records``).
    ``multi_line=False`` spares the search for quotes where no cell holds a line break. A name that does not end in ``.csv`` is
    refused before anything is read.
    """
    if not path.endswith(".csv"):
        raise ValueError(f"not a CSV file: {path}")
    options = {"header": True, "multiLine": multi_line, "quote": '"', "escape": '"', "encoding": "UTF-8"}
    reader = spark.read.options(**options)
    whole = (reader.schema(schema) if schema is not None else reader).csv(path)
    return read_records(spark, path, whole.schema) if multi_line else whole


def spread(df: DataFrame) -> DataFrame:
    """Give a table that comes in fewer splits than there are cores one partition per core.

    Large tables have more splits than cores and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def list_columns(df: DataFrame) -> list[tuple[int, str]]:
    """Position and name of every column a user may choose."""
    return list(enumerate(df.columns))


def jdbc_slices(low: int, high: int, rows_per_slice: int = 1_000_000) -> dict[str, int]:
    """Bounds and number of parallel reads for a table with ids from ``low`` to ``high``."""
    return {
        "lowerBound": low,
        "upperBound": high + 1,
        "numPartitions": max(1, math.ceil((high - low + 1) / rows_per_slice)),
    }


def _read_jdbc(spark: SparkSession, source: Mapping[str, str]) -> DataFrame:
    options = dict(source)
    table = options.pop("dbtable")
    bounds = (
        spark.read.format("jdbc")
        .options(**options, dbtable=f"(SELECT min(id) AS low, max(id) AS high FROM {table}) AS bounds")
        .load()
        .first()
    )
    if bounds["low"] is None:
        return spark.createDataFrame([], TRAINING_SCHEMA)
    slices = jdbc_slices(int(bounds["low"]), int(bounds["high"]))
    reader = spark.read.format("jdbc").options(**options, dbtable=table, partitionColumn="id", **slices)
    return reader.load().select("id", "text", "category")


def load_training(spark: SparkSession, language: str, source, supported=SUPPORTED) -> DataFrame:
    """Training rows ``(id, text, category)`` of one language.

    ``source`` is a DataFrame or parquet path with a ``lang`` column, or per language a table: a dictionary from
    code to parquet path, or to JDBC options with ``dbtable``. A language outside ``supported`` and a source that
    cannot be read are logged and give an empty frame, whatever the kind of source.

    JDBC reads are sliced by the range of ``id``: rows without an id come with the first slice, and ids that leave large
    gaps make uneven slices.
    """
    try:
        if language not in supported:
            raise ValueError(f"unsupported language code {language!r}")
        if isinstance(source, Mapping):
            source = source[language]
            if isinstance(source, Mapping):
                return _read_jdbc(spark, source)
            return spark.read.parquet(source).select("id", "text", "category")
        df = source if isinstance(source, DataFrame) else spark.read.parquet(source)
        return df.where(F.col("lang") == language).select("id", "text", "category")
    except Exception as error:
        log.error("could not load the training table for %r: %s", language, error)
        return spark.createDataFrame([], TRAINING_SCHEMA)


def training_source(app_table: DataFrame | None, uploaded: DataFrame | None) -> DataFrame:
    """The application table when there is one, else the uploaded one."""
    if app_table is not None:
        return app_table
    if uploaded is not None:
        return uploaded
    raise ValueError("no training table")
