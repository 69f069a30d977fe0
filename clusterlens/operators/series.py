"""Node time series: rebasing, derived CPU / memory / disk / network
metrics, event split, stage bands, peaks, long form, overlay and per-band
statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.functions.numeric import ieee_div
from clusterlens.functions.strings import short_host
from clusterlens.operators.ordered import last_before, with_next

METRICS = ("CPU", "MEMUSED", "DISK", "NETWORK")
# Fill colours of alternating stage bands (first is pink).
BAND_COLOURS = ("pink", "orange")


def origin(series: DataFrame) -> DataFrame:
    """One row: the earliest epoch of the series."""
    return series.agg(F.min("epoch").alias("origin"))


def rebase(df: DataFrame, origin_df: DataFrame) -> DataFrame:
    """epoch - origin. The origin is a one-row aggregate used as a scalar
    subquery: computed once, then a literal in the projection (no join)."""
    return df.withColumn("epoch", F.col("epoch") - origin_df.select("origin").scalar())


def derive_metrics(series: DataFrame) -> DataFrame:
    """CPU = 100 - idle; MEMUSED = used / (free + buff + cach) * 100 (the
    denominator leaves out 'used', so it may pass 100); DISK = writ + read;
    NETWORK = recv + send."""
    return series.select(
        "epoch", "node",
        (100 - F.col("idl")).alias("CPU"),
        (ieee_div(F.col("used"), F.col("free") + F.col("buff") + F.col("cach")) * 100).alias("MEMUSED"),
        (F.col("writ") + F.col("read")).alias("DISK"),
        (F.col("recv") + F.col("send")).alias("NETWORK"))


def metric_series(series: DataFrame) -> DataFrame:
    """Rebased series with the four derived metrics."""
    return derive_metrics(rebase(series, origin(series)))


def split_kind(marks: DataFrame) -> DataFrame:
    """Tag each mark global / stage / node."""
    kind = (F.when(F.col("node") == "global", "global").when(F.col("node") == "stage", "stage")
            .otherwise("node"))
    return marks.withColumn("kind", kind)


def stage_bands(marks: DataFrame) -> DataFrame:
    """Stage marks in (epoch, seq) order; band i spans [epoch_i, epoch_i+1],
    the last band has zero width; colours alternate starting with pink. Marks of
    several applications (column ``app_id``) give each application's own bands."""
    by = ["app_id"] if "app_id" in marks.columns else []
    stages = marks.where(F.col("node") == "stage").select(*by, "epoch", "seq", "event")
    banded = with_next(stages, ["epoch", "seq"], "epoch", "next_epoch", by)
    return banded.select(
        *by, (F.col("pos") + 1).alias("band"), "seq", "event",
        F.col("epoch").alias("start"),
        F.coalesce(F.col("next_epoch"), F.col("epoch")).alias("end"),
        F.when(F.col("pos") % 2 == 0, BAND_COLOURS[0]).otherwise(BAND_COLOURS[1]).alias("colour"))


def metric_peak(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*[F.max(m).alias(f"max_{m}") for m in METRICS])


def node_count(series: DataFrame) -> DataFrame:
    return series.agg(F.countDistinct("node").alias("nodes"))


def long_form(metrics: DataFrame) -> DataFrame:
    """``(node, epoch, metric, value)``: one row per sample and metric."""
    pairs = ", ".join(f"'{m}', {m}" for m in METRICS)
    return metrics.selectExpr("node", "epoch", f"stack({len(METRICS)}, {pairs}) AS (metric, value)")


def overlay(marks: DataFrame) -> DataFrame:
    """Marks per chart panel: node marks belong to their node's panel;
    global and stage marks belong to every panel, stated once with
    ``panel = '*'`` instead of being copied to each node (the copy would be
    marks x nodes rows)."""
    tagged = split_kind(marks)
    return tagged.select("epoch", "event", "kind", "seq",
                         F.when(F.col("kind") == "node", F.col("node")).otherwise(F.lit("*"))
                         .alias("panel"))


def in_bands(samples: DataFrame, bands: DataFrame) -> DataFrame:
    """``samples`` with the ``band`` they fall in (start <= epoch < end); samples in
    no band are left out. The bands must not overlap (as those of ``stage_bands`` of one
    application): each sample then belongs to the last band that has
    started, found by an as-of sweep. The samples move once, a band is one
    row however long it lasts. ``bands`` is read twice: write it first when
    it is dear to compute."""
    open_ = bands.where(F.col("end") > F.col("start")).select("start", F.col("end").alias("_end"), "band")
    found = last_before(samples, open_, "epoch", "start", ["_end", "band"])
    return found.where(F.col("epoch") < F.col("_end")).drop("_end")


def in_overlapping_bands(samples: DataFrame, bands: DataFrame, bucket_seconds: int) -> DataFrame:
    """As ``in_bands`` for bands that may overlap: a sample gives a row for each
    band it is in. An equi-join on time buckets with the exact test after it; a
    band gives length / ``bucket_seconds`` rows."""
    width = F.lit(bucket_seconds).cast("bigint")
    b = bands.where(F.col("end") > F.col("start")).select(
        "band", "start", F.col("end").alias("_end"),
        F.explode(F.sequence(F.floor(F.col("start") / width).cast("bigint"),
                             F.floor((F.col("end") - 1) / width).cast("bigint"))).alias("bucket"))
    s = samples.withColumn("bucket", F.floor(F.col("epoch") / width).cast("bigint"))
    hit = (F.col("epoch") >= F.col("start")) & (F.col("epoch") < F.col("_end"))
    return s.join(b, "bucket", "inner").where(hit).drop("start", "_end", "bucket")


def band_stats(metrics: DataFrame, bands: DataFrame, bucket_seconds: int | None = None) -> DataFrame:
    """Samples, mean and max of each metric per (band, node). Bands that overlap
    need ``bucket_seconds`` (see ``in_overlapping_bands``)."""
    j = in_bands(metrics, bands) if bucket_seconds is None else in_overlapping_bands(metrics, bands, bucket_seconds)
    aggs = [F.count(F.lit(1)).alias("samples")]
    for m in METRICS:
        aggs += [F.avg(m).alias(f"avg_{m}"), F.max(m).alias(f"max_{m}")]
    return j.groupBy("band", "node").agg(*aggs)


def marks_from_events(norm: DataFrame) -> DataFrame:
    """Event marks ``(app_id, epoch, node, event, seq)`` from the unified
    runtime-event table: application and job rows are 'global', stage rows
    'stage', executor and block-manager rows belong to their node (an
    executor-removed row takes the node of that executor's added row: a join
    on one row per executor). Task rows are not marks. ``seq`` orders stage
    marks (2*stageId, +1 when completed)."""
    a = F.map_from_arrays(F.col("keys"), F.col("vals"))
    ev = (norm.where((F.col("kind") == "event") & ~F.col("event").startswith("TASK-"))
          .select("app_id", "epoch", "event", a.alias("a")))
    nodes = (ev.where(F.col("event") == "EXECUTOR-ADDED")
             .groupBy("app_id", F.col("a")["executorId"].alias("_ex"))
             .agg(F.max(short_host(F.col("a")["node"])).alias("_exnode")))
    ev = ev.withColumn("_ex", F.col("a")["executorId"]).join(nodes, ["app_id", "_ex"], "left")
    e = F.col("event")
    node = (F.when(e.startswith("APPLICATION-") | e.startswith("JOB-"), F.lit("global"))
            .when(e.startswith("STAGE-"), F.lit("stage"))
            .when(e == "BLOCK-MANAGER-ADDED", short_host(F.col("a")["host"]))
            .when(e == "EXECUTOR-ADDED", short_host(F.col("a")["node"]))
            .otherwise(F.col("_exnode")))
    ident = F.coalesce(F.col("a")["stageId"], F.col("a")["jobId"], F.col("a")["executorId"])
    label = F.when(ident.isNull(), e).otherwise(F.concat_ws(" ", e, ident))
    seq = F.when(e.startswith("STAGE-"), F.col("a")["stageId"].cast("bigint") * 2
                 + F.when(e == "STAGE-COMPLETED", 1).otherwise(0))
    return ev.where(~e.startswith("BLOCK-UDPATED")).select(
        "app_id", "epoch", node.alias("node"), label.alias("event"), seq.alias("seq"))
