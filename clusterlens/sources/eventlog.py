"""Spark JSON event logs.

``read_event_log`` reads newline-delimited JSON event logs with an explicit
schema (no inference pass over the data at scale; pass ``schema=None`` to
infer). ``event_log_path`` writes, with Spark, an event log in Spark 4's
layout derived from the task model of ``events`` (see ``sources.tasks``),
so the log grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.sources.materialize import materialized, write_lines
from clusterlens.sources.tasks import APP_ID, APP_NAME, task_table

_BM = "STRUCT<`Executor ID`: STRING, `Host`: STRING, `Port`: INT>"
EVENT_LOG_SCHEMA = ", ".join([
    "`Event` STRING", "`App ID` STRING", "`App Name` STRING", "`User` STRING", "`Timestamp` BIGINT",
    "`Executor ID` STRING", "`Executor Info` STRUCT<`Host`: STRING, `Total Cores`: INT>",
    "`Removed Reason` STRING",
    f"`Block Manager ID` {_BM}", "`Maximum Memory` BIGINT",
    f"`Block Updated Info` STRUCT<`Block Manager ID`: {_BM}, `Block ID`: STRING, "
    "`Storage Level`: STRUCT<`Use Disk`: BOOLEAN, `Use Memory`: BOOLEAN, `Deserialized`: BOOLEAN, "
    "`Replication`: INT>, `Memory Size`: BIGINT, `Disk Size`: BIGINT>",
    "`Job ID` BIGINT", "`Submission Time` BIGINT", "`Completion Time` BIGINT",
    "`Stage IDs` ARRAY<BIGINT>", "`Job Result` STRUCT<`Result`: STRING, `Exception`: STRING>",
    "`Stage Info` STRUCT<`Stage ID`: BIGINT, `Stage Attempt ID`: INT, `Stage Name`: STRING, "
    "`Number of Tasks`: INT, `Parent IDs`: ARRAY<BIGINT>, `Submission Time`: BIGINT, "
    "`Completion Time`: BIGINT, `Failure Reason`: STRING>",
    "`Stage ID` BIGINT", "`Stage Attempt ID` INT", "`Task Type` STRING",
    "`Task End Reason` STRUCT<`Reason`: STRING, `Class Name`: STRING, `Description`: STRING>",
    "`Task Info` STRUCT<`Task ID`: BIGINT, `Index`: INT, `Attempt`: INT, `Launch Time`: BIGINT, "
    "`Executor ID`: STRING, `Host`: STRING, `Locality`: STRING, `Speculative`: BOOLEAN, "
    "`Finish Time`: BIGINT, `Failed`: BOOLEAN, `Killed`: BOOLEAN>",
    "`Task Metrics` STRUCT<`Memory Bytes Spilled`: BIGINT, `Disk Bytes Spilled`: BIGINT, "
    "`Shuffle Read Metrics`: STRUCT<`Remote Blocks Fetched`: BIGINT, `Local Blocks Fetched`: BIGINT, "
    "`Remote Bytes Read`: BIGINT, `Local Bytes Read`: BIGINT, `Total Records Read`: BIGINT>, "
    "`Shuffle Write Metrics`: STRUCT<`Shuffle Bytes Written`: BIGINT, `Shuffle Write Time`: BIGINT, "
    "`Shuffle Records Written`: BIGINT>, "
    "`Output Metrics`: STRUCT<`Bytes Written`: BIGINT, `Records Written`: BIGINT>>",
    "`Spark Properties` MAP<STRING, STRING>",
])
# The fields by which starts and ends are known.
BOUNDARY_SCHEMA = ", ".join([
    "`Event` STRING", "`Timestamp` BIGINT", "`Job ID` BIGINT", "`Submission Time` BIGINT", "`Completion Time` BIGINT",
    "`Stage Info` STRUCT<`Stage ID`: BIGINT, `Submission Time`: BIGINT, `Completion Time`: BIGINT>",
    "`Task Info` STRUCT<`Task ID`: BIGINT, `Launch Time`: BIGINT, `Finish Time`: BIGINT>",
])

# Executor settings recorded in the derived log's environment.
ENV_PROPERTIES = {"spark.executor.instances": "8", "spark.executor.cores": "1",
                  "spark.executor.memory": "1g", "spark.sql.shuffle.partitions": "64"}


def read_event_log(spark: SparkSession, path: str, schema: str | None = EVENT_LOG_SCHEMA) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def read_open_log(spark: SparkSession, path: str) -> DataFrame:
    """``(event, body, line)``: every line of a log of unknown shape, its event
    name and the whole of it as a VARIANT, so that no event and no field is lost.
    A line that is not JSON has a null body (and event) and keeps its text."""
    body = F.try_parse_json("value")
    lines = spark.read.text(path).select(body.alias("body"), "value")
    return lines.select(F.try_variant_get("body", "$.Event", "string").alias("event"), "body", F.col("value").alias("line"))


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields)).alias("value")


def _lit(name: str, value) -> Column:
    return F.lit(value).alias(name)


# What a row of the log to be is: a line, or a task and the kind of line it becomes.
_TASK = ("task_id", "launch_ms", "finish_ms", "stage_id", "host", "executor", "locality", "failed", "bytes_written",
         "has_metrics")


def _lines_of(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("value").alias("line"), F.lit(None).cast("string").alias("kind"))


def _tasks_as(t: DataFrame, kind: Column, **more: Column) -> DataFrame:
    return t.select(*_TASK, kind.alias("kind"), *[c.alias(n) for n, c in more.items()])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _dealt_lines(rows: DataFrame, files: int) -> DataFrame:
    """``rows`` as lines (``value``), dealt to ``files`` tasks by a hash of the line.
    The line is built again after the shuffle: a task is a small part of its lines."""
    dealt = rows.withColumn("_h", F.xxhash64(_line(rows.columns))).repartition(files, "_h")
    keep = [c for c in rows.columns if c == "app"]
    return dealt.select(_line(rows.columns).alias("value"), *keep)


def derived_event_log(t: DataFrame, app_id: str = APP_ID) -> DataFrame:
    """The event log as JSON text lines (``value``), built from the task
    model: application, executor and block-manager, job, stage and task
    events. Per-app/host/stage figures are aggregates of the task table."""
    rows = _log_rows(t, app_id)
    return rows.select(_line(rows.columns).alias("value"))


def _log_rows(t: DataFrame, app_id: str = APP_ID) -> DataFrame:
    app = t.agg(F.min("launch_ms").alias("start"), F.max("finish_ms").alias("end"),
                F.sort_array(F.collect_set("stage_id")).alias("stages"))
    hosts = t.groupBy("host", "executor").agg(F.min("launch_ms").alias("first"),
                                              F.max("finish_ms").alias("last"))
    stages = t.groupBy("stage_id", "event_type").agg(
        F.min("launch_ms").alias("first"), F.max("finish_ms").alias("last"),
        F.count(F.lit(1)).cast("int").alias("n"))
    bm = F.struct(F.col("executor").alias("Executor ID"), F.col("host").alias("Host"),
                  F.lit(7337).alias("Port"))
    parents = F.when(F.col("stage_id") > 0, F.array(F.col("stage_id") - 1)).otherwise(
        F.array().cast("array<bigint>"))
    stage_info = [F.col("stage_id").alias("Stage ID"), F.lit(0).alias("Stage Attempt ID"),
                  F.col("event_type").alias("Stage Name"), F.col("n").alias("Number of Tasks"),
                  parents.alias("Parent IDs")]
    props = F.create_map(*[F.lit(x) for kv in sorted(ENV_PROPERTIES.items()) for x in kv])
    parts = [
        app.select(_json(_lit("Event", "SparkListenerApplicationStart"), _lit("App Name", APP_NAME),
                         _lit("App ID", app_id), F.col("start").alias("Timestamp"), _lit("User", "spark"))),
        app.select(_json(_lit("Event", "SparkListenerEnvironmentUpdate"),
                         props.alias("Spark Properties"))),
        hosts.select(_json(_lit("Event", "SparkListenerExecutorAdded"), F.col("first").alias("Timestamp"),
                           F.col("executor").alias("Executor ID"),
                           F.struct(F.col("host").alias("Host"), F.lit(1).alias("Total Cores"))
                           .alias("Executor Info"))),
        hosts.select(_json(_lit("Event", "SparkListenerBlockManagerAdded"), bm.alias("Block Manager ID"),
                           F.lit(1 << 30).cast("bigint").alias("Maximum Memory"),
                           F.col("first").alias("Timestamp"))),
        hosts.select(_json(_lit("Event", "SparkListenerExecutorRemoved"), F.col("last").alias("Timestamp"),
                           F.col("executor").alias("Executor ID"),
                           _lit("Removed Reason", "application finished"))),
        app.select(_json(_lit("Event", "SparkListenerJobStart"), F.lit(0).cast("bigint").alias("Job ID"),
                         F.col("start").alias("Submission Time"), F.col("stages").alias("Stage IDs"))),
        app.select(_json(_lit("Event", "SparkListenerJobEnd"), F.lit(0).cast("bigint").alias("Job ID"),
                         F.col("end").alias("Completion Time"),
                         F.struct(F.lit("JobSucceeded").alias("Result")).alias("Job Result"))),
        stages.select(_json(_lit("Event", "SparkListenerStageSubmitted"),
                            F.struct(*stage_info, F.col("first").alias("Submission Time"))
                            .alias("Stage Info"))),
        stages.select(_json(_lit("Event", "SparkListenerStageCompleted"),
                            F.struct(*stage_info, F.col("first").alias("Submission Time"),
                                     F.col("last").alias("Completion Time")).alias("Stage Info"))),
        _tasks_as(t, F.lit("start")),
        _tasks_as(t, F.lit("end")),
        app.select(_json(_lit("Event", "SparkListenerApplicationEnd"), F.col("end").alias("Timestamp"))),
    ]
    return _union([p if "kind" in p.columns else _lines_of(p) for p in parts])


def _line(columns: list[str]) -> Column:
    """The JSON text of a row of the log to be."""
    task_info = [F.col("task_id").alias("Task ID"), F.col("task_id").cast("int").alias("Index"),
                 F.lit(0).alias("Attempt"), F.col("launch_ms").alias("Launch Time"),
                 F.col("executor").alias("Executor ID"), F.col("host").alias("Host"),
                 F.col("locality").alias("Locality"), F.lit(False).alias("Speculative")]
    k = F.coalesce(F.col("bytes_written"), F.lit(0))
    metrics = F.when(F.col("has_metrics"), F.struct(
        F.lit(0).cast("bigint").alias("Memory Bytes Spilled"),
        F.lit(0).cast("bigint").alias("Disk Bytes Spilled"),
        F.struct((F.col("task_id") % 7 * 100).alias("Remote Bytes Read"),
                 (F.col("task_id") % 1000).alias("Local Bytes Read")).alias("Shuffle Read Metrics"),
        F.struct((k * 10).alias("Shuffle Bytes Written"),
                 (F.col("finish_ms") - F.col("launch_ms")).alias("Shuffle Write Time")
                 ).alias("Shuffle Write Metrics"),
        F.struct(k.alias("Bytes Written"), F.lit(1).cast("bigint").alias("Records Written")
                 ).alias("Output Metrics")))
    reason = F.when(F.col("failed"), F.struct(F.lit("ExceptionFailure").alias("Reason"),
                                              F.lit("java.lang.RuntimeException").alias("Class Name"),
                                              F.lit("k is zero, retry").alias("Description"))
                    ).otherwise(F.struct(F.lit("Success").alias("Reason"),
                                         F.lit(None).cast("string").alias("Class Name"),
                                         F.lit(None).cast("string").alias("Description")))
    kinds = {
        "start": _json(_lit("Event", "SparkListenerTaskStart"), F.col("stage_id").alias("Stage ID"),
                       F.lit(0).alias("Stage Attempt ID"), F.struct(*task_info).alias("Task Info")),
        "end": _json(_lit("Event", "SparkListenerTaskEnd"), F.col("stage_id").alias("Stage ID"),
                     F.lit(0).alias("Stage Attempt ID"), _lit("Task Type", "ResultTask"),
                     reason.alias("Task End Reason"),
                     F.struct(*task_info, F.col("finish_ms").alias("Finish Time"),
                              F.col("failed").alias("Failed"), F.lit(False).alias("Killed"))
                     .alias("Task Info"),
                     metrics.alias("Task Metrics")),
    }
    if "block" in columns:
        bm = F.struct(F.col("executor").alias("Executor ID"), F.col("host").alias("Host"), F.lit(7337).alias("Port"))
        disk = F.col("task_id") % 3 == 0
        level = F.struct(disk.alias("Use Disk"), F.lit(True).alias("Use Memory"), (~disk).alias("Deserialized"),
                         F.lit(1).alias("Replication"))
        size = F.coalesce(F.col("bytes_written"), F.lit(0)) * 10
        kinds["block"] = _json(
            _lit("Event", "SparkListenerBlockUpdated"), F.col("finish_ms").alias("Timestamp"),
            F.struct(bm.alias("Block Manager ID"), F.col("block").alias("Block ID"), level.alias("Storage Level"),
                     size.alias("Memory Size"), F.when(disk, size).otherwise(0).alias("Disk Size")).alias("Block Updated Info"))
    if "heap" in columns:
        metrics_update = F.array(F.struct(F.col("task_id").alias("Task ID"), F.col("heap").alias("Heap")))
        kinds["update"] = _json(_lit("Event", "SparkListenerExecutorMetricsUpdate"), F.col("executor").alias("Executor ID"),
                                metrics_update.alias("Metrics Updated"),
                                F.when(F.col("task_id") % 4 == 0, F.col("locality")).alias("Note"))
    line = F.when(F.col("kind").isNull(), F.col("line"))
    for kind, text in kinds.items():
        line = line.when(F.col("kind") == kind, text)
    return line


def _block_rows(t: DataFrame) -> DataFrame:
    """Block updates: a task with metrics stores a block of its stage's data set,
    and every fifth task a block of a broadcast value."""
    rdd = F.when(F.col("has_metrics"), F.concat(F.lit("rdd_"), F.col("stage_id"), F.lit("_"), F.col("task_id")))
    shared = F.when(F.col("task_id") % 5 == 0, F.concat(F.lit("broadcast_"), F.col("stage_id")))
    blocks = t.withColumn("block", F.explode(F.array_compact(F.array(rdd, shared))))
    return _tasks_as(blocks, F.lit("block"), block=F.col("block"))


def derived_block_updates(t: DataFrame) -> DataFrame:
    """``_block_rows`` as JSON text lines."""
    rows = _block_rows(t).withColumn("line", F.lit(None).cast("string"))
    return rows.select(_line(rows.columns).alias("value"))


def _files(spark: SparkSession) -> int:
    """The lines of a log are dealt to as many tasks as a shuffle has partitions: ``events`` may be one file."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_log_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of an event log with lines that the explicit schema does not know: a
    metrics update per task, with a note on every fourth, and cut-off lines."""
    def write(path: str) -> None:
        t = task_table(spark, sf_dir)
        updates = _tasks_as(t, F.lit("update"), heap=F.col("bytes_written"))
        cut_off = t.where(F.col("task_id") % 50 == 0).select(F.concat(F.lit('{"Event":"cut'), "task_id").alias("value"))
        write_lines(_dealt_lines(_union([_log_rows(t), updates, _lines_of(cut_off)]), _files(spark)), path)

    return materialized(spark, sf_dir, "eventlog-open", write)


APPLICATIONS = 3


def applications_log_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the event logs of several applications, one sub-folder each:
    tasks are dealt by id, and every application logs its block updates too."""
    def write(path: str) -> None:
        logs = []
        for i in range(APPLICATIONS):
            t = task_table(spark, sf_dir).where(F.col("task_id") % APPLICATIONS == i)
            name = f"{APP_ID[:-4]}{i:04d}"
            logs.append(_union([_log_rows(t, name), _block_rows(t)]).withColumn("app", F.lit(name)))
        write_lines(_dealt_lines(_union(logs), _files(spark)), path, "app")

    return materialized(spark, sf_dir, "eventlog-applications", write)


def event_log_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the derived event log (written on first use), one
    sub-folder per application as with rolling event logs."""
    def write(path: str) -> None:
        lines = _dealt_lines(_log_rows(task_table(spark, sf_dir)), _files(spark))
        write_lines(lines.withColumn("app", F.lit(APP_ID)), path, "app")

    return materialized(spark, sf_dir, "eventlog", write)
