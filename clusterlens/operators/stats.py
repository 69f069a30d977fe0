"""Pair join, moment sums and correlations over ``(key, x)`` / ``(key, y)``
pair tables.

Scale design: the joined pair table has ``|h_k| * |t_k|`` rows for a key k,
so one hot key would blow it up quadratically. Everything except the literal
``pair_join`` is therefore computed from per-key pre-aggregates of each side
(count, sum, sum of squares), which map-side partial aggregation builds
without skew, joined one row per key per side. The sums over all joined rows
follow exactly: sum(x) = sum_k Sx_k * n_t(k), sum(xy) = sum_k Sx_k * Sy_k, ...
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clusterlens.functions.numeric import pearson
from clusterlens.operators.ordered import range_of
from clusterlens.sources.materialize import cut

KEY = "track7Id"

# The verdict texts of the correlation report.
VERDICT_POSITIVE = "a reasonable, positive correlation"
VERDICT_NEGATIVE = "a reasonable, negative correlation"
VERDICT_WEAK = "a weak correlation"
VERDICT_NONE = "almost no correlation [but that does not mean independence]"


def pair_join(h: DataFrame, t: DataFrame, key: str = KEY) -> DataFrame:
    """Inner equi-join of the two pair tables; duplicate keys multiply.
    AQE's skew-join split handles a key much larger than the others."""
    return h.join(t, key, "inner")


def moment_columns(joined: DataFrame, x: str, y: str) -> DataFrame:
    """``(x, y, xy, x2, y2)`` per joined row."""
    return joined.select(F.col(x).alias("x"), F.col(y).alias("y"),
                         (F.col(x) * F.col(y)).alias("xy"),
                         (F.col(x) * F.col(x)).alias("x2"), (F.col(y) * F.col(y)).alias("y2"))


def _side(df: DataFrame, key: str, v: str, p: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(f"{p}n"), F.sum(v).alias(f"{p}s"),
                               F.sum(F.col(v) * F.col(v)).alias(f"{p}ss"))


def moment_sums(h: DataFrame, t: DataFrame, x: str, y: str, key: str = KEY) -> DataFrame:
    """One row: distinct joined keys, joined rows, and sum of x, y, xy, x^2,
    y^2 over the joined rows — without materialising the joined rows."""
    j = _side(h, key, x, "h").join(_side(t, key, y, "t"), key, "inner")
    hn, tn = F.col("hn").cast("double"), F.col("tn").cast("double")
    return j.agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum(F.col("hn") * F.col("tn")).cast("bigint").alias("rows"),
        F.sum(F.col("hs") * tn).alias("sum_x"),
        F.sum(F.col("ts") * hn).alias("sum_y"),
        F.sum(F.col("hs") * F.col("ts")).alias("sum_xy"),
        F.sum(F.col("hss") * tn).alias("sum_x2"),
        F.sum(F.col("tss") * hn).alias("sum_y2"),
    )


def moment_sums_one_table(df: DataFrame, x: str, y: str, key: str = KEY) -> DataFrame:
    """``moment_sums`` when both pair tables are projections of one table
    (x pairs = rows with x <> 0, y pairs = rows with y <> 0): the per-key
    aggregates of both sides come from a single aggregation over that table,
    and keys present on both sides are those with both counts > 0 — the join
    disappears, leaving one scan and one shuffle of per-key partials."""
    hx, ty = F.col(x) != 0, F.col(y) != 0
    g = df.groupBy(key).agg(
        F.count(F.when(hx, 1)).alias("hn"), F.sum(F.when(hx, F.col(x))).alias("hs"),
        F.sum(F.when(hx, F.col(x) * F.col(x))).alias("hss"),
        F.count(F.when(ty, 1)).alias("tn"), F.sum(F.when(ty, F.col(y))).alias("ts"),
        F.sum(F.when(ty, F.col(y) * F.col(y))).alias("tss"))
    j = g.where((F.col("hn") > 0) & (F.col("tn") > 0))
    hn, tn = F.col("hn").cast("double"), F.col("tn").cast("double")
    return j.agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum(F.col("hn") * F.col("tn")).cast("bigint").alias("rows"),
        F.sum(F.col("hs") * tn).alias("sum_x"),
        F.sum(F.col("ts") * hn).alias("sum_y"),
        F.sum(F.col("hs") * F.col("ts")).alias("sum_xy"),
        F.sum(F.col("hss") * tn).alias("sum_x2"),
        F.sum(F.col("tss") * hn).alias("sum_y2"),
    )


def key_count(h: DataFrame, t: DataFrame, key: str = KEY) -> DataFrame:
    """Number of distinct keys present on both sides (= keys after the join)."""
    return (h.select(key).distinct().join(t.select(key).distinct(), key, "inner")
            .agg(F.count(F.lit(1)).alias("keys")))


def correlation(sums: DataFrame, n: str = "keys") -> DataFrame:
    """Pearson's r from the moment sums, with ``n`` either the joined key
    count (as the correlation workload's report does) or the joined row count."""
    return sums.select(pearson(F.col(n), F.col("sum_x"), F.col("sum_y"), F.col("sum_xy"),
                               F.col("sum_x2"), F.col("sum_y2")).alias("r"))


def verdict(r: Column) -> Column:
    """Text verdict on r; NaN (which Spark orders above every number) first."""
    return (F.when(r.isNull() | F.isnan(r), F.lit(VERDICT_NONE))
            .when(r >= 0.5, F.lit(VERDICT_POSITIVE))
            .when(r <= -0.5, F.lit(VERDICT_NEGATIVE))
            .when(F.abs(r) >= 0.1, F.lit(VERDICT_WEAK))
            .otherwise(F.lit(VERDICT_NONE)))


def average_ranks(counts: DataFrame, value: str, weight: str,
                  partitions: int | None = None, group: str | None = None) -> DataFrame:
    """Average (tie-aware) ranks from a table of distinct values and their
    multiplicities: rank(v) = #(values < v) + (mult(v) + 1) / 2, within each
    ``group`` when given.

    A distributed prefix sum: deal the distinct values to ranges with fixed
    bounds (``ordered.range_of``), take the running sum inside each range, then
    add the totals of all earlier ranges from a table with one row per range
    and group (bounded, so broadcasting it is safe). Only distinct values move,
    so a value shared by a third of all rows is still one row here. JVM-side
    throughout.
    """
    g = [group] if group else []
    ranged = range_of(counts.select(*g, value, F.col(weight).cast("bigint").alias("w")), [*g, value], partitions, "pid")
    in_range = Window.partitionBy("pid", *g).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("before", F.coalesce(F.sum("w").over(in_range), F.lit(0).cast("bigint")))
    totals = ranged.groupBy("pid", *g).agg(F.sum("w").alias("tot"))
    earlier = Window.partitionBy(*g).orderBy("pid") if g else Window.orderBy("pid")
    offsets = totals.select("pid", *g, (F.sum("tot").over(earlier) - F.col("tot")).alias("offset"))
    return (local.join(F.broadcast(offsets), ["pid", *g], "inner")
            .select(*g, value, (F.col("offset") + F.col("before") + (F.col("w") + 1) / 2.0)
                    .alias("rank")))


def rank_correlation(h: DataFrame, t: DataFrame, x: str, y: str, key: str = KEY) -> DataFrame:
    """Spearman's rho over the joined rows: Pearson on average ranks of x and
    of y among all joined rows, from per-key aggregates (no pair rows).

    Both sides run through one plan, tagged 0 (x) and 1 (y): a row of
    one side stands for as many joined rows as the other side has rows with
    its key; ranks are taken per side over those multiplicities; then per
    key the rank sums of both sides combine as in ``moment_sums``. The counts
    per (key, value) and per value are read several times, so they are written once.
    """
    hc = h.groupBy(key).agg(F.count(F.lit(1)).alias("cnt"))
    tc = t.groupBy(key).agg(F.count(F.lit(1)).alias("cnt"))
    # weight of a side-0 row = rows of side 1 with the key, and vice versa
    other = (tc.select(key, F.lit(0).alias("side"), F.col("cnt").alias("on"))
             .unionByName(hc.select(key, F.lit(1).alias("side"), F.col("cnt").alias("on"))))
    sides = (h.select(key, F.col(x).alias("v"), F.lit(0).alias("side"))
             .unionByName(t.select(key, F.col(y).alias("v"), F.lit(1).alias("side"))))
    kv = cut(sides.groupBy("side", key, "v").agg(F.count(F.lit(1)).alias("c"))
             .join(other, ["side", key], "inner"), "rank-pairs")
    mult = cut(kv.groupBy("side", "v").agg(F.sum(F.col("c") * F.col("on")).alias("m")), "rank-values")
    ranks = average_ranks(mult, "v", "m", group="side")
    r = F.col("rank")

    def on(side: int, e):
        return F.sum(F.when(F.col("side") == side, e))

    per_key = (kv.join(ranks, ["side", "v"], "inner").groupBy(key)
               .agg(on(0, F.col("c")).alias("hn"), on(0, F.col("c") * r).alias("hs"),
                    on(0, F.col("c") * r * r).alias("hss"), on(1, F.col("c")).alias("tn"),
                    on(1, F.col("c") * r).alias("ts"), on(1, F.col("c") * r * r).alias("tss")))
    hn, tn = F.col("hn").cast("double"), F.col("tn").cast("double")
    sums = per_key.agg(F.sum(hn * tn).alias("n"), F.sum(F.col("hs") * tn).alias("sx"),
                       F.sum(F.col("ts") * hn).alias("sy"), F.sum(F.col("hs") * F.col("ts")).alias("sxy"),
                       F.sum(F.col("hss") * tn).alias("sxx"), F.sum(F.col("tss") * hn).alias("syy"))
    return sums.select(pearson(F.col("n"), F.col("sx"), F.col("sy"), F.col("sxy"),
                               F.col("sxx"), F.col("syy")).alias("rho"))
