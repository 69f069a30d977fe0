"""Metric-sink CSV files: ``<appId>.<executor>.<metric parts>.csv``, a
header line starting ``t,`` then ``epoch,value[,...]`` rows.

Two layouts are read: a flat folder of sink files (the sink's own output;
the name is the file name), and a Spark-written folder with one
``sink=<file name>`` sub-folder per sink file. ``sink_files_path`` writes
the latter from ``events``: app ``joe_1700000000``, executor = user_id % 4,
metric ``jvm.<event_type>.used``, rows (epoch second, value); plus a
DAGScheduler file and a file of another application, both to be dropped by
the collation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.sources.materialize import materialized
from clusterlens.functions.timecols import epoch_seconds
from clusterlens.sources.tables import table

SINK_APP = "joe_1700000000"
OTHER_APP = "other_1600000000"


def sink_name_of_path(path: Column) -> Column:
    """The sink file name: the ``sink=`` folder for a Spark-written layout,
    else the file's own name."""
    in_dir = F.regexp_extract(path, r"/sink=([^/]+)/[^/]*$", 1)
    return F.when(in_dir != "", in_dir).otherwise(F.regexp_extract(path, r"([^/]+)$", 1))


def read_sink_files(spark: SparkSession, path: str, layout: str = "partitioned") -> DataFrame:
    """``(sink, value)`` lines of all sink files. Flat layout: plain files
    in ``path`` whose name ends ``.csv`` (not recursive)."""
    reader = spark.read
    if layout == "flat":
        reader = reader.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "false")
    df = reader.text(path)
    return df.select(sink_name_of_path(F.col("_metadata.file_path")).alias("sink"), "value")


def derived_sink_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", spread_out=True).select("ts", "user_id", "event_type", "value")
    sec = epoch_seconds(F.col("ts")).cast("string")
    body = F.concat(sec, F.lit(","), F.col("value").cast("string"))
    name = F.concat(F.lit(SINK_APP + "."), (F.col("user_id") % 4).cast("string"), F.lit(".jvm."),
                    F.col("event_type"), F.lit(".used.csv"))
    rows = ev.select(name.alias("sink"), body.alias("value"))
    extra = ev.where(F.col("event_type") == "click").select(
        F.lit(f"{SINK_APP}.driver.DAGScheduler.job.activeJobs.csv").alias("sink"), body.alias("value")) \
        .unionByName(ev.where(F.col("event_type") == "view").select(
            F.lit(f"{OTHER_APP}.0.jvm.heap.used.csv").alias("sink"), body.alias("value")))
    rows = rows.unionByName(extra)
    headers = rows.select("sink").distinct().select("sink", F.lit("t,value").alias("value"))
    return rows.unionByName(headers)


def sink_files_path(spark: SparkSession, sf_dir: str) -> str:
    return materialized(spark, sf_dir, "sinkfiles", lambda path: (
        derived_sink_lines(spark, sf_dir).write.mode("overwrite").partitionBy("sink").text(path)))


def redelivered_sink_path(spark: SparkSession, sf_dir: str) -> str:
    """The sink files twice: under their own names, and as rotated copies."""
    lines = derived_sink_lines(spark, sf_dir)
    names = F.array(F.col("sink"), F.concat("sink", F.lit(".1")))
    return materialized(spark, sf_dir, "sinkfiles-redelivered", lambda path: (
        lines.select(F.explode(names).alias("sink"), "value").write.mode("overwrite").partitionBy("sink").text(path)))


def restarted_sink_path(spark: SparkSession, sf_dir: str) -> str:
    """Sink files whose source restarted every day: a header per day, with the
    user as a further field on odd days; rows of every 97th event are cut off
    after the epoch. One file per sink, in order of time."""
    ev = table(spark, sf_dir, "events").select("ts", "event_id", "user_id", "event_type", "value")
    ev = ev.where(F.col("event_type").isNotNull()).withColumn("sec", epoch_seconds(F.col("ts")))
    day = F.floor(F.col("sec") / 86400)
    name = F.concat(F.lit(SINK_APP + "."), (F.col("user_id") % 4).cast("string"), F.lit(".jvm."),
                    F.col("event_type"), F.lit(".used.csv"))
    fields = F.array(F.col("sec").cast("string"), F.col("value").cast("string"))
    line = (F.when(F.col("event_id") % 97 == 0, F.col("sec").cast("string"))
            .when(day % 2 == 0, F.array_join(fields, ","))
            .otherwise(F.array_join(F.array_append(fields, F.col("user_id").cast("string")), ",")))
    rows = ev.select(name.alias("sink"), day.alias("day"), F.col("event_id").alias("ord"), line.alias("value"))
    headers = rows.select("sink", "day").distinct().select(
        "sink", "day", F.lit(-1).cast("bigint").alias("ord"),
        F.when(F.col("day") % 2 == 0, "t,value").otherwise("t,value,user").alias("value"))
    return materialized(spark, sf_dir, "sinkfiles-restarted", lambda path: (
        rows.unionByName(headers).repartition("sink").sortWithinPartitions("sink", "day", "ord")
        .select("sink", "value").write.mode("overwrite").partitionBy("sink").text(path)))
