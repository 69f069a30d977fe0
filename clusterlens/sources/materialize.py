"""Written tables in the shared folder (``spark.checkpoint.dir``).

Derived inputs that must exist as files (event logs, listener files, sink
files) are written once per session and input location, then read back
with the normal readers. A folder counts as written only when its
``_SUCCESS`` marker exists, so a write cut short by a lost executor or
driver is simply redone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clusterlens.session import shared_dir, source_key


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def materialized(spark: SparkSession, sf_dir: str, name: str,
                 write: Callable[[str], None]) -> str:
    """Path of the derived input ``name`` for ``sf_dir``; ``write(path)`` is
    called (a Spark write job) only when no complete copy exists yet."""
    path = shared_dir(spark, "derived", source_key(sf_dir), name)
    if not _exists(spark, path + "/_SUCCESS"):
        write(path)
    return path


# Files of written lines are compressed and end after so many lines, so that
# none outgrows a task that reads it (a compressed file is not split).
LINES_PER_FILE = 100_000
# Folders that a task writes to at a time, one open file each; from there on
# Spark sorts the rest of its rows by folder.
OPEN_FOLDERS = 64


def write_lines(lines: DataFrame, path: str, folders: str | None = None) -> None:
    """Write text lines in compressed files, with a sub-folder for each value
    of ``folders``: rows go straight to their folder's file, unsorted."""
    spark, key = lines.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    writer = lines.write.mode("overwrite").option("compression", "gzip")
    writer = writer.option("maxRecordsPerFile", LINES_PER_FILE)
    old = spark.conf.get(key)
    spark.conf.set(key, str(OPEN_FOLDERS))
    try:
        (writer.partitionBy(folders) if folders else writer).text(path)
    finally:
        spark.conf.set(key, old)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as parquet to a fresh folder in the
    shared checkpoint folder and read it back. Later plans re-read a columnar
    table (with pruning and pushed filters) instead of recomputing ``df``,
    and a lost executor re-reads files rather than re-running the lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, "cuts", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.parquet(path)
