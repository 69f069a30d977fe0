"""Streaming versions of the collation and event jobs.

They read a folder as a file stream, apply the same DataFrame
operators as the batch jobs and append to a parquet file sink (exactly-once
through the sink's commit log and the checkpoint). ``trigger`` defaults to
``availableNow`` (process what is there, then stop); pass e.g.
``{"processingTime": "1 second"}`` for a long-running job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.operators import runtime as D
from clusterlens.operators.sinkfiles import collate
from clusterlens.sources.eventlog import BOUNDARY_SCHEMA, EVENT_LOG_SCHEMA
from clusterlens.sources.sinkfiles import sink_name_of_path


def _run(df: DataFrame, out: str, checkpoint: str, trigger: dict | None) -> None:
    writer = (df.writeStream.format("parquet").outputMode("append")
              .option("path", out).option("checkpointLocation", checkpoint))
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    q = writer.start()
    q.awaitTermination()


def stream_collate(spark: SparkSession, sink_dir: str, out: str, checkpoint: str, app_id: str,
                   host: str, user: str, trigger: dict | None = None) -> None:
    """Collate metric-sink lines as files arrive."""
    lines = (spark.readStream.format("text").load(sink_dir)
             .select(sink_name_of_path(F.col("_metadata.file_path")).alias("sink"), "value"))
    _run(collate(lines, app_id, host, user), out, checkpoint, trigger)


def collate_once(lines: DataFrame, app_id: str, host: str, user: str, delay: str = "1 day") -> DataFrame:
    """Collated rows of a stream of sink lines, each once, however often and
    under whatever rotated name (``x.csv``, ``x.csv.1``) its file is delivered: a row
    is known by its executor, metric and line, whose first field is its time. A
    row more than ``delay`` older than the newest row is late and dropped, new
    or not, so the state holds the rows of one ``delay``. Equal lines of one sink
    are one row; a line without a whole number of seconds at its start has no time, and
    is left out."""
    named = lines.withColumn("sink", F.regexp_replace("sink", r"\.csv\.[0-9]+$", ".csv"))
    rows = collate(named, app_id, host, user)
    at = F.timestamp_seconds(F.substring_index("line", ",", 1).try_cast("bigint"))
    rows = rows.withColumn("ts", at).where(F.col("ts").isNotNull()).withWatermark("ts", delay)
    return rows.dropDuplicatesWithinWatermark(["host", "executor", "metric", "user", "line"]).drop("ts")


def stream_collate_once(spark: SparkSession, sink_dir: str, out: str, checkpoint: str, app_id: str,
                        host: str, user: str, delay: str = "1 day", trigger: dict | None = None) -> None:
    """Collate metric-sink lines as files arrive, also if they arrive again."""
    lines = (spark.readStream.format("text").load(sink_dir)
             .select(sink_name_of_path(F.col("_metadata.file_path")).alias("sink"), "value"))
    _run(collate_once(lines, app_id, host, user, delay), out, checkpoint, trigger)


def event_stream(spark: SparkSession, log_dir: str) -> DataFrame:
    """Normalised runtime events from event-log files as they arrive
    (explicit schema; app id from the folder name, so no join)."""
    log = spark.readStream.schema(EVENT_LOG_SCHEMA).json(log_dir)
    return D.normalise(log, scope="path")


def boundary_stream(spark: SparkSession, log_dir: str, events: tuple[str, ...], scopes: tuple[str, ...]) -> DataFrame:
    """Starts or ends in event-log files as they arrive: of each line only the
    fields that tell what began or ended when."""
    log = spark.readStream.schema(BOUNDARY_SCHEMA).json(log_dir)
    return D.boundaries_from_log(log, events, scopes)


def stream_events(spark: SparkSession, log_dir: str, out: str, checkpoint: str,
                  trigger: dict | None = None) -> None:
    _run(D.event_rows(event_stream(spark, log_dir)), out, checkpoint, trigger)


FAR = 4_102_444_800  # 2100-01-01: a closing mark of this time says that nothing follows


def close_input(spark: SparkSession, marks: str, epoch: int = FAR) -> None:
    """Put a closing mark into the folder ``marks``: no event before ``epoch``
    will come any more. Streams that read the folder move their watermark there,
    so windows, sessions and joins that are still open come out, each once.
    Marks must grow; after one of ``FAR`` nothing more is taken in."""
    spark.range(1).select(F.lit(str(epoch)).alias("value")).coalesce(1).write.mode("append").text(marks)


def _marks(spark: SparkSession, marks: str, delay: str) -> DataFrame:
    """Closing marks as event times, ``delay`` later so that the watermark
    arrives at the mark itself."""
    close_input(spark, marks, 0)  # the folder must exist; this mark moves nothing
    at = F.timestamp_seconds(F.expr("try_cast(value AS bigint)")) + F.expr(f"INTERVAL {delay}")
    return spark.readStream.format("text").load(marks).select(at.alias("ts"))


def _with_marks(rows: DataFrame, marks: DataFrame | None, delay: str, **fill: Column) -> DataFrame:
    """``rows`` (with ``ts``) under a watermark that closing marks move too. A
    mark is a row with ``real`` 0. Nothing above may filter on columns of one
    side alone: Catalyst would push that below the watermark, and lose the marks."""
    rows = rows.withColumn("real", F.lit(1))
    if marks is not None:
        others = [fill.get(c, F.lit(None)).cast(rows.schema[c].dataType).alias(c)
                  for c in rows.columns if c not in ("ts", "real")]
        rows = rows.unionByName(marks.select("ts", *others, F.lit(0).alias("real")))
    return rows.withWatermark("ts", delay)


def _task_ends(events: DataFrame) -> DataFrame:
    return (events.where((F.col("kind") == "event") & (F.col("event") == "TASK-END"))
            .select(F.timestamp_seconds("epoch").alias("ts"),
                    F.element_at(F.map_from_arrays("keys", "vals"), F.lit("node")).alias("node")))


def _rate(events: DataFrame, span: Column, delay: str, marks: DataFrame | None) -> DataFrame:
    return (_with_marks(_task_ends(events), marks, delay)
            .groupBy(span.alias("span"), "node").agg(F.sum("real").alias("tasks")).where(F.col("tasks") > 0)
            .select(F.unix_seconds(F.col("span.start")).alias("window_start"),
                    F.unix_seconds(F.col("span.end")).alias("window_end"), "node", "tasks"))


def task_rate(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes",
              marks: DataFrame | None = None) -> DataFrame:
    """Tasks ended per event-time window and node. Rows later than the
    watermark (max event time - ``delay``) are dropped; in append mode a
    window is emitted once the watermark passes its end, for the last ones
    by a closing mark."""
    return _rate(events, F.window("ts", window), delay, marks)


def busy_sessions(events: DataFrame, gap: str = "10 minutes", delay: str = "10 minutes",
                  marks: DataFrame | None = None) -> DataFrame:
    """Stretches in which a node ended tasks less than ``gap`` apart; a session
    ends ``gap`` after its last task. Emitted like the windows of ``task_rate``."""
    return _rate(events, F.session_window("ts", gap), delay, marks)


def live_durations(starts: DataFrame, ends: DataFrame, max_run: str = "1 day", delay: str = "10 minutes",
                   marks: DataFrame | None = None) -> DataFrame:
    """``(app_id, scope, id, start, elapsed)``: each start joined with its end
    within ``max_run``, as an interval join of two streams: a start stays in
    the state until the watermark is ``max_run`` past it, an end until the
    watermark is past it. A start whose end has not come by then is emitted
    with a null ``elapsed``. Input rows as of ``runtime.boundaries``."""
    def side(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.withColumn("ts", F.timestamp_seconds("epoch"))
        # marks of the two sides have ids that never meet
        rows = _with_marks(rows, marks, delay, app_id=F.lit(""), scope=F.lit(""), id=F.lit(name))
        return rows.select(*[F.col(c).alias(f"{name}_{c}") for c in ("app_id", "scope", "id", "epoch", "ts", "real")])

    same = [F.col(f"s_{c}") == F.col(f"e_{c}") for c in ("app_id", "scope", "id")]
    within = (F.col("e_ts") >= F.col("s_ts")) & (F.col("e_ts") <= F.col("s_ts") + F.expr(f"INTERVAL {max_run}"))
    joined = side(starts, "s").join(side(ends, "e"), same[0] & same[1] & same[2] & within, "left_outer")
    joined = joined.where(F.col("s_real") + F.coalesce("e_real", F.lit(0)) > 0)
    return joined.select(F.col("s_app_id").alias("app_id"), F.col("s_scope").alias("scope"), F.col("s_id").alias("id"),
                         F.col("s_epoch").alias("start"), (F.col("e_epoch") - F.col("s_epoch")).alias("elapsed"))


def stream_task_rate(spark: SparkSession, log_dir: str, out: str, checkpoint: str,
                     trigger: dict | None = None, marks: str | None = None) -> None:
    """Append the task rate to ``out``; ``marks`` is the folder of closing marks."""
    closing = _marks(spark, marks, "10 minutes") if marks else None
    _run(task_rate(event_stream(spark, log_dir), marks=closing), out, checkpoint, trigger)


def stream_busy_sessions(spark: SparkSession, log_dir: str, out: str, checkpoint: str, gap: str = "10 minutes",
                         trigger: dict | None = None, marks: str | None = None) -> None:
    closing = _marks(spark, marks, "10 minutes") if marks else None
    _run(busy_sessions(event_stream(spark, log_dir), gap, marks=closing), out, checkpoint, trigger)


def stream_durations(spark: SparkSession, log_dir: str, out: str, checkpoint: str, max_run: str = "1 day",
                     scopes: tuple[str, ...] = D.SCOPES,
                     trigger: dict | None = None, marks: str | None = None) -> None:
    """Append the elapsed times of what starts and ends in the log."""
    closing = _marks(spark, marks, "10 minutes") if marks else None
    starts, ends = (boundary_stream(spark, log_dir, which, scopes) for which in (D.STARTS, D.ENDS))
    _run(live_durations(starts, ends, max_run, marks=closing), out, checkpoint, trigger)
