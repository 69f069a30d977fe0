"""Metric-sink collation: keep one application's files, decode executor
and metric from the file name, drop headers, tag rows with host and user;
and the typed long form of the rows using each file's own header.

Everything is row-local except the long form's header lookup: one header
row per file joined back on the file name (``long_form``), or the last header
above each row (``long_form_by_header``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens.operators.filelines import with_last_above


def _bits() -> F.Column:
    return F.split(F.col("sink"), r"\.")


def collate(lines: DataFrame, app_id: str, host: str, user: str) -> DataFrame:
    """``(host, executor, metric, user, line)`` for the sink lines of
    ``app_id``: files whose name ends ``.csv``, whose first name part is the
    app id and whose name parts (joined without separator) do not contain
    ``DAGScheduler``; executor = 2nd part; metric = 3rd..second-to-last parts
    joined by '_'; header lines (``t,...``) dropped."""
    bits = _bits()
    n = F.size(bits)
    keep = (F.col("sink").endswith(".csv") & (F.element_at(bits, 1) == app_id)
            & ~F.array_join(bits, "").contains("DAGScheduler") & ~F.col("value").startswith("t,"))
    short = host.split(".")[0]
    return lines.where(keep).select(
        F.lit(short).alias("host"), F.element_at(bits, 2).alias("executor"),
        F.array_join(F.slice(bits, 3, F.greatest(n - 3, F.lit(0))), "_").alias("metric"),
        F.lit(user).alias("user"), F.col("value").alias("line"))


def append_collated(collated: DataFrame, path: str, app_id: str) -> None:
    """Append the collated rows to a shared parquet store, one folder per
    application."""
    collated.withColumn("app_id", F.lit(app_id)).write.mode("append").partitionBy("app_id").parquet(path)


def long_form(lines: DataFrame, app_id: str) -> DataFrame:
    """``(executor, metric, epoch, field, value)``: each body row unpivoted
    against its own file's header (``t,<field>,...``)."""
    bits = _bits()
    n = F.size(bits)
    mine = lines.where(F.col("sink").endswith(".csv") & (F.element_at(bits, 1) == app_id)
                       & ~F.array_join(bits, "").contains("DAGScheduler"))
    headers = (mine.where(F.col("value").startswith("t,"))
               .groupBy("sink").agg(F.split(F.min("value"), ",").alias("header")))
    body = mine.where(~F.col("value").startswith("t,")).select("sink", F.split("value", ",").alias("f"))
    j = body.join(headers, "sink", "inner")
    def tail(c: str) -> Column:
        return F.slice(F.col(c), F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))

    pairs = F.arrays_zip(tail("header").alias("field"), tail("f").alias("v"))
    out = j.select(F.element_at(bits, 2).alias("executor"),
                   F.array_join(F.slice(bits, 3, F.greatest(n - 3, F.lit(0))), "_").alias("metric"),
                   F.element_at("f", 1).cast("bigint").alias("epoch"),
                   F.inline(pairs))
    return out.select("executor", "metric", "epoch", "field", F.col("v").cast("double").alias("value"))


def _with_headers(lines: DataFrame, app_id: str) -> DataFrame:
    """Body rows (sink name parts, fields) with the header last seen above."""
    bits = _bits()
    mine = lines.where(F.col("sink").endswith(".csv") & (F.element_at(bits, 1) == app_id)
                       & ~F.array_join(bits, "").contains("DAGScheduler"))
    is_header = F.col("value").startswith("t,")
    known = with_last_above(mine, F.when(is_header, F.split("value", ",")), "header")
    return known.where(~is_header).withColumn("f", F.split("value", ",", -1))


def _fits() -> Column:
    return F.coalesce(F.size("header") == F.size("f"), F.lit(False)) & (F.size("f") > 1) \
        & F.element_at("f", 1).rlike(r"^-?[0-9]{1,18}\z")


def long_form_by_header(lines: DataFrame, app_id: str) -> DataFrame:
    """``(executor, metric, epoch, field, value)`` of numbered sink lines
    ``(file, block, pos, sink, value)``: each body row unpivoted against the last
    header above it in its file, so a sink whose fields change mid-file (a
    restarted source) is read right. An empty or non-numeric field is a null
    value; rows that do not fit their header are in ``header_misfits``."""
    bits = _bits()
    n = F.size(bits)
    pairs = F.arrays_zip(F.slice("header", 2, F.size("header") - 1).alias("field"),
                         F.slice("f", 2, F.size("f") - 1).alias("v"))
    out = _with_headers(lines, app_id).where(_fits()).select(
        F.element_at(bits, 2).alias("executor"),
        F.array_join(F.slice(bits, 3, F.greatest(n - 3, F.lit(0))), "_").alias("metric"),
        F.element_at("f", 1).cast("bigint").alias("epoch"), F.inline(pairs))
    return out.select("executor", "metric", "epoch", "field", F.expr("try_cast(v AS double)").alias("value"))


def header_misfits(lines: DataFrame, app_id: str) -> DataFrame:
    """``(sink, line)``: body rows without a header above them, with another
    number of fields than it, or without an epoch."""
    return _with_headers(lines, app_id).where(~_fits()).select("sink", F.col("value").alias("line"))
