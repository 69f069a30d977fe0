"""Text corpora as one row per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.functions.text import split_lines
from clusterlens.sources.tables import table


def read_lines(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    """Text files as ``value`` lines (Hadoop line reader semantics)."""
    df = spark.read.text(path)
    if min_partitions and df.rdd.getNumPartitions() < min_partitions:
        df = df.repartition(min_partitions)
    return df


def lines_of(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Explode a text column into lines, one row per line, as if each text were
    a file: one final line break adds no line and an empty text has none.

    ``keep`` columns (e.g. a document id) are carried along with ``line_no``.
    """
    return docs.select(*keep, F.posexplode(split_lines(F.col(text_col))).alias("line_no", "value"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the ``documents`` corpus: ``(doc_id, line_no, value)``."""
    return lines_of(table(spark, sf_dir, "documents", spread_out=True).select("doc_id", "text"), keep=("doc_id",))
