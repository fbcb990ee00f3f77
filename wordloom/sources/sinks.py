"""Writing result tables."""

from datetime import datetime

from pyspark.sql import DataFrame

# Prefixes and time stamp of result files.
PROCESSED = "processedCsv"
CLASSIFIED = "classifiedCsv"
STAMP = "%Y-%m-%d_%H-%M-%S"


def write_result(df: DataFrame, folder: str, prefix: str, single_file: bool = False) -> str:
    """Write the whole table as CSV with a header under a time-stamped name and return the path.

    The result is a directory of part files, written in parallel. ``single_file`` makes it one part file, for
    results small enough to pass through one task.
    """
    stamp = datetime.now().strftime(STAMP)
    path = f"{folder.rstrip('/')}/{prefix}_{stamp}.csv"
    out = df.coalesce(1) if single_file else df
    (
        out.write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path
