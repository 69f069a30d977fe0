"""The benchmark tables (one parquet file/folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Table -> primary-key columns, used to spread a table whose scan yields
# fewer partitions than the cluster has cores.
TABLE_KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",),
    "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",),
    "documents": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",),
    "benchmark": ("item_id",), "labels": ("doc_id",), "conversations": ("conv_id", "turn"),
}
TABLES = tuple(TABLE_KEYS)


def spread(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Hash-repartition ``df`` to the default parallelism when its scan has
    fewer partitions than that (e.g. a file with one row group), so that
    row-local CPU work uses every core. Only for inputs of heavy row-local work
    (parsing, tokenising): it moves the rows once, which an aggregate or a
    filter of a plain scan would not repay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)


# (application, path) -> schema. Finding a parquet schema runs a job, so a path
# is asked once a session; later reads of it only plan.
_SCHEMAS: dict[tuple[str, str], StructType] = {}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Read parquet with the schema that the path had when it was first read."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, spread_out: bool = False) -> DataFrame:
    """Read one table. ``spread_out`` (for inputs of row-local CPU work)
    applies ``spread``; column pruning and filters still reach the parquet
    scan (they are pushed below the repartition)."""
    if name not in TABLE_KEYS:
        raise ValueError(f"unknown table {name!r}")
    df = read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df, TABLE_KEYS[name]) if spread_out else df
