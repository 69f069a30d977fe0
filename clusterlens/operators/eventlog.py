"""SQL over a JSON event log: application id, event types, executor
additions (nested fields with spaces in their names)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def app_id(log: DataFrame) -> DataFrame:
    """The application id (deterministic form of 'first non-null')."""
    return log.where(F.col("`App ID`").isNotNull()).agg(F.min("`App ID`").alias("app_id"))


def app_ids(log: DataFrame) -> DataFrame:
    """The ids of all applications whose logs are read, each once."""
    return log.where(F.col("`App ID`").isNotNull()).select(F.col("`App ID`").alias("app_id")).distinct()


def _view(log: DataFrame) -> str:
    name = f"eventlog_{uuid.uuid4().hex[:12]}"
    log.createOrReplaceTempView(name)
    return name


def event_types(log: DataFrame) -> DataFrame:
    return log.sparkSession.sql(f"SELECT DISTINCT Event FROM {_view(log)}")


def executor_adds(log: DataFrame) -> DataFrame:
    return log.sparkSession.sql(
        f"SELECT `Executor Info`.Host, Timestamp FROM {_view(log)} "
        "WHERE Event = 'SparkListenerExecutorAdded'")


def executor_lines(adds: DataFrame) -> DataFrame:
    """``host, @timestamp`` text per executor addition."""
    return adds.select(F.concat(F.col("Host"), F.lit(", @"), F.col("Timestamp").cast("string")).alias("line"))


def event_shapes(log: DataFrame) -> DataFrame:
    """``(event, lines, shape)`` of an open log (``sources.read_open_log``): the
    merged schema of each event kind, found by one aggregation with map-side
    combining (a state is a schema, whatever the number of lines). Lines that are not
    JSON come under a null event with the shape VOID."""
    return log.groupBy("event").agg(F.count(F.lit(1)).alias("lines"), F.schema_of_variant_agg("body").alias("shape"))


def unknown_fields(log: DataFrame, known: str) -> DataFrame:
    """``(event, field, shape, lines)``: top-level fields of an open log that the
    schema ``known`` (DDL) does not name, each with its merged shape."""
    names = StructType.fromDDL(known).fieldNames()
    fields = log.where(F.col("body").isNotNull()).select("event", "body")
    fields = fields.lateralJoin(log.sparkSession.tvf.variant_explode(F.col("body").outer()))
    return (fields.where(F.col("key").isNotNull() & ~F.col("key").isin(names)).groupBy("event", F.col("key").alias("field"))
            .agg(F.schema_of_variant_agg("value").alias("shape"), F.count(F.lit(1)).alias("lines")))


def field_values(log: DataFrame, event: str, **paths: tuple[str, str]) -> DataFrame:
    """Columns of one event kind of an open log, each by (path, type); null
    where a line has no such field or another type."""
    return log.where(F.col("event") == event).select(
        *[F.try_variant_get("body", path, kind).alias(name) for name, (path, kind) in paths.items()])


def broken_lines(log: DataFrame) -> DataFrame:
    """The text of the lines that are not JSON."""
    return log.where(F.col("body").isNull()).select("line")
