"""Dynamic-network spells.

Vertex spells ``(onset, terminus, vertex_id, name, type, info, ord)`` and
edge spells ``(onset, terminus, tail, head, type)``, spells being
``[onset, terminus)`` (onset = terminus is a point spell). ``network_spells``
derives them from ``events`` in hours since the first event: each event is a
task (spell of ``event_id % 7`` hours, info = its locality) linked to its
worker node, to the one 'data' vertex and to its stage; workers and stages
span their tasks; the data vertex spans everything. ``ord`` is the row
order of the vertex list (workers, data, stages, tasks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.functions.timecols import epoch_seconds
from clusterlens.sources.tables import table
from clusterlens.sources.tasks import APP_NAME, LOCALITIES, NODES, stage_id

VERTEX_SCHEMA = "onset bigint, terminus bigint, vertex_id string, name string, type string, info string"
EDGE_SCHEMA = "onset bigint, terminus bigint, tail string, head string, type string"


def read_vertex_spells(spark: SparkSession, path: str) -> DataFrame:
    # NA marks a missing value, an empty field is an empty text
    return spark.read.csv(path, header=True, schema=VERTEX_SCHEMA, nullValue="NA", emptyValue="")


def read_edge_spells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=EDGE_SCHEMA)


def _task_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    sec = epoch_seconds(F.col("ts"))
    first = ev.agg(F.min(sec).alias("first")).scalar()
    onset = F.floor((sec - first) / 3600).cast("bigint")
    return (ev.where(F.col("event_type").isNotNull())
            .withColumn("stage_id", stage_id(ev))
            .select(onset.alias("onset"), (onset + F.col("event_id") % 7).alias("terminus"),
                    F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("task"),
                    F.col("event_id"),
                    F.concat(F.lit("n"), (F.col("user_id") % NODES).cast("string")).alias("node"),
                    F.concat(F.lit("S"), F.col("stage_id").cast("string")).alias("stage"),
                    "stage_id", "event_type",
                    F.element_at(F.array(*[F.lit(x) for x in LOCALITIES]),
                                 (F.col("event_id") % 4 + 1).cast("int")).alias("locality")))


def network_spells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = _task_spells(spark, sf_dir)
    tasks = t.select("onset", "terminus", F.col("task").alias("vertex_id"), F.col("task").alias("name"),
                     F.lit("task").alias("type"), F.col("locality").alias("info"),
                     (F.lit(3_000_000_000) + F.col("event_id")).alias("ord"))
    workers = t.groupBy("node").agg(F.min("onset").alias("onset"), F.max("terminus").alias("terminus")) \
        .select("onset", "terminus", F.col("node").alias("vertex_id"), F.col("node").alias("name"),
                F.lit("worker").alias("type"), F.lit(APP_NAME).alias("info"),
                F.expr("substring(node, 2)").cast("bigint").alias("ord"))
    stages = t.groupBy("stage", "stage_id", "event_type").agg(
        F.min("onset").alias("onset"), F.max("terminus").alias("terminus")) \
        .select("onset", "terminus", F.col("stage").alias("vertex_id"), F.col("stage").alias("name"),
                F.lit("stage").alias("type"), F.col("event_type").alias("info"),
                (F.lit(2_000_000_000) + F.col("stage_id")).alias("ord"))
    data = t.agg(F.lit(0).cast("bigint").alias("onset"), F.max("terminus").alias("terminus")) \
        .select("onset", "terminus", F.lit("data").alias("vertex_id"), F.lit("datasets").alias("name"),
                F.lit("data").alias("type"), F.lit("").alias("info"),
                F.lit(1_000_000_000).cast("bigint").alias("ord"))
    vertices = workers.unionByName(data).unionByName(stages).unionByName(tasks)
    edges = (t.select("onset", "terminus", F.col("task").alias("tail"), F.col("node").alias("head"),
                      F.lit("taskToNode").alias("type"))
             .unionByName(t.select("onset", "terminus", F.col("task").alias("tail"), F.lit("data").alias("head"),
                                   F.lit("taskToData").alias("type")))
             .unionByName(t.select("onset", "terminus", F.col("task").alias("tail"), F.col("stage").alias("head"),
                                   F.lit("taskToStage").alias("type"))))
    return vertices, edges


def task_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute spells: a worker's 'activity' is the locality of the tasks
    it runs, each valid over the task's spell (for latest-value lookups)."""
    t = _task_spells(spark, sf_dir)
    return t.select("onset", "terminus", F.col("node").alias("vertex_id"), F.col("task").alias("source"),
                    F.col("locality").alias("value"))
