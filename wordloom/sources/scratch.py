"""Tables written half-way through a job, in the folder the cluster shares.

``spark.checkpoint.dir`` of the session names it. Every session writes into a folder of its own there, which is deleted when
the driver's Python process ends. A table goes earlier, once no plan can read it any more: results are read lazily, and every
DataFrame made from a table shares the JVM's object for its files, so that object is held by a weak reference, and the folder is
deleted after the JVM has let it go. Each new table, and ``sweep``, looks for such folders.
"""

import atexit
import contextlib
import gc
import threading
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the folder its context was given for checkpoints."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


@cache
def _session_folder(spark: SparkSession, folder: str) -> str:
    path = f"{folder}/wordloom/{uuid.uuid4().hex}"

    def delete() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone already; then the folder is left to its owner
            _delete(spark, path)

    atexit.register(delete)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_session_folder(spark, scratch_folder(spark))}/{name}-{uuid.uuid4().hex}"


#: Weak references to what the JVM holds of a table, the table's folder, and its session.
_written: list[tuple[object, str, SparkSession]] = []
_lock = threading.Lock()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def sweep(spark: SparkSession, collect: bool = False) -> int:
    """Delete the tables that no plan can read any more; how many are left. ``collect`` asks Python and the JVM to look first."""
    if collect:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    with _lock:
        gone = [e for e in _written if e[2] is spark and e[0].get() is None]
        _written[:] = [e for e in _written if not any(e is g for g in gone)]
    for _, path, _ in gone:
        _delete(spark, path)
    return sum(e[2] is spark for e in _written)


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table and read it back.

    Cuts the lineage for jobs that read their input several times, survives lost executors, and gives Catalyst
    a true size, so that it broadcasts the table only when it is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    sweep(spark)
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    relation = table._jdf.queryExecution().analyzed().collectLeaves().apply(0).relation()
    with _lock:
        _written.append((spark.sparkContext._jvm.java.lang.ref.WeakReference(relation), path, spark))
    return table
