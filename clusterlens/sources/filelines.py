"""Text files as lines that know their place.

A file larger than a split is read by several tasks, and a shuffle loses the
order of the lines. Each line therefore carries its file, the byte at which
its split starts, and a number that grows along the split. Formats whose rows
depend on earlier rows of the file (continuation lines, changing headers)
are read from these (``operators/filelines.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_numbered_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(file, block, pos, value)``: the line's file, the start of its split
    and its place in it. One split is read by one task in order, so ``pos``
    orders its lines, and every reading of the plan gives the same places."""
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), "value")
