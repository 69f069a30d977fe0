"""Edge lists: tab-separated, no header, two columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EDGE_SCHEMA = "src string, dst string"


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=False, schema=EDGE_SCHEMA)


def write_edge_list(edges: DataFrame, path: str) -> None:
    edges.select("src", "dst").write.mode("overwrite").csv(path, sep="\t", header=False)
