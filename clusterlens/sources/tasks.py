"""A task-level runtime model derived from the ``events`` table.

Each event row stands for one task of one application: task id = event_id,
launch = event time (ms), finish = launch + value seconds (rounded to ms),
stage = rank of the event type (0-based, by name), host = n<user_id%8>
.cluster.local, executor = user_id % 8, locality by event_id % 4, failed when
the type is 'error' and k = 0, bytes written = k (from props), task metrics
absent when event_id % 10 = 0. This feeds the event-log, listener, graph and
network builders so that all of them scale with ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.functions.timecols import epoch_millis
from clusterlens.sources.tables import table

# Locality names by event_id % 4, and the node count.
LOCALITIES = ["PROCESS_LOCAL", "NODE_LOCAL", "RACK_LOCAL", "ANY"]
NODES = 8
APP_ID = "app-20240101000000-0000"
APP_NAME = "events replay"


def stage_id(events: DataFrame) -> Column:
    """The 0-based rank of a row's event type among the distinct types: its
    place in their ordered list, a scalar subquery (one value per type, found
    with map-side combining; no join, no window)."""
    types = events.agg(F.array_sort(F.collect_set("event_type")).alias("types")).scalar()
    return F.array_position(types, F.col("event_type")) - 1


def task_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type",
                                               "value", "props")
    launch = epoch_millis(F.col("ts"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    node = F.col("user_id") % NODES
    return (ev.where(F.col("event_type").isNotNull())
            .withColumn("stage_id", stage_id(ev))
            .select(
                F.col("event_id").alias("task_id"),
                launch.alias("launch_ms"),
                (launch + F.round(F.col("value") * 1000).cast("bigint")).alias("finish_ms"),
                "stage_id",
                "event_type",
                F.concat(F.lit("n"), node.cast("string"), F.lit(".cluster.local")).alias("host"),
                node.cast("string").alias("executor"),
                F.element_at(F.array(*[F.lit(x) for x in LOCALITIES]),
                             (F.col("event_id") % 4 + 1).cast("int")).alias("locality"),
                ((F.col("event_type") == "error") & (k == 0)).alias("failed"),
                k.alias("bytes_written"),
                (F.col("event_id") % 10 != 0).alias("has_metrics"),
            ))
