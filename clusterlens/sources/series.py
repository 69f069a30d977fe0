"""Node time series and event marks.

``node_series`` derives one row per node-second of OS metrics from
``lineitem``; ``event_marks`` derives marks (global / stage / node) from
``events``, shifted into the span of the series. ``read_series`` and
``read_marks`` read the CSV forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.functions.timecols import epoch_seconds
from clusterlens.sources.tables import table

SERIES_SCHEMA = ("epoch bigint, node string, idl double, used double, free double, buff double, "
                 "cach double, writ double, read double, recv double, send double")
MARKS_SCHEMA = "epoch bigint, node string, event string, seq bigint"

# Fixed value: seconds from 1996-01-01 to 2024-01-01 UTC, moving the event
# marks into the span of the node series.
MARK_SHIFT = 883612800


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=SERIES_SCHEMA)


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=MARKS_SCHEMA)


def node_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (epoch_seconds(F.col("l_shipdate")) + F.col("l_linenumber")).alias("epoch"),
        F.concat(F.lit("n"), (F.col("l_suppkey") % 8).cast("string")).alias("node"),
        (F.col("l_quantity") * 2).alias("idl"),
        F.col("l_extendedprice").alias("used"),
        F.col("l_quantity").alias("free"),
        F.col("l_linenumber").cast("double").alias("buff"),
        F.col("l_partkey").cast("double").alias("cach"),
        F.col("l_discount").alias("writ"),
        F.col("l_tax").alias("read"),
        F.col("l_quantity").alias("recv"),
        F.col("l_linenumber").cast("double").alias("send"),
    )


def event_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    node = (F.when(F.col("event_type") == "signup", "stage")
            .when(F.col("event_type") == "error", "global")
            .otherwise(F.concat(F.lit("n"), (F.col("user_id") % 8).cast("string"))))
    return ev.select((epoch_seconds(F.col("ts")) - MARK_SHIFT).alias("epoch"),
                     node.alias("node"), F.col("event_type").alias("event"),
                     F.col("event_id").alias("seq"))


def application_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event marks of three applications that run at the same time (app_id)."""
    app = F.concat(F.lit("app-"), F.pmod(F.col("seq"), F.lit(3)).cast("string"))
    return event_marks(spark, sf_dir).withColumn("app_id", app)
