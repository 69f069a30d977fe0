"""Centred co-moments as states that merge: ``(n, at_x, at_y, mean_x, mean_y,
cxx, cyy, cxy)`` of a set of (x, y) rows. at is an origin near the values, means
are relative to it, and cxy is the sum of (x - mean of x) * (y - mean of y).

Sums of products (``stats.moment_sums``) lose all digits when the values lie
far from zero beside their spread, since ``n * Sxy - Sx * Sy`` cancels. States
hold what is left after centring, so nothing of the offset enters. A batch is
reduced once to its states, these are stored, and any union of batches is a merge
of states: rows of earlier batches are never read again.

Defined results: rows with a null or NaN in x or y do not count; a group
without rows has no state; a null in a grouping column is a group of its own;
r is NaN where x or y does not vary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.functions.numeric import ieee_div
from clusterlens.sources.materialize import cut


def _counted(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v)


def _middle(v: str) -> Column:
    """A value near the median. Any value does where rows are alike; the median is
    one that outliers do not move. Which one it is changes no result."""
    return F.percentile_approx(v, 0.5, 1000)


def _origin(rows: DataFrame, v: str, at: float | None) -> Column:
    """The given origin, else a middle value (a scalar subquery over one column)."""
    return rows.agg(_middle(v)).scalar() if at is None else F.lit(float(at))


def value_states(rows: DataFrame, x: str, y: str, by: tuple[str, ...] = (),
                 at: tuple[float, float] | None = None) -> DataFrame:
    """A state per group of plain rows. ``at`` names values near x and y where
    they are known, and saves the pass that finds them. Spark's central moments are
    centred and combined map-side, so a group with a third of all rows moves
    as one row a task."""
    rows = rows.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = rows.where(_counted(F.col("x")) & _counted(F.col("y")))
    at_x, at_y = at or (None, None)
    rows = rows.select(*by, "x", "y", _origin(rows, "x", at_x).alias("at_x"), _origin(rows, "y", at_y).alias("at_y"))
    n = F.count(F.lit(1))
    dx, dy = F.col("x") - F.col("at_x"), F.col("y") - F.col("at_y")
    return (rows.groupBy(*by).agg(
        n.alias("n"), F.max("at_x").alias("at_x"), F.max("at_y").alias("at_y"), F.avg(dx).alias("mean_x"),
        F.avg(dy).alias("mean_y"), (F.var_pop(dx) * n).alias("cxx"), (F.var_pop(dy) * n).alias("cyy"),
        (F.covar_pop(dx, dy) * n).alias("cxy")).where(F.col("n") > 0))


def pair_states(h: DataFrame, t: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """A state per key of the joined pairs of two tables, without the pairs: a
    key's pairs are the product of its rows on both sides, so x and y are
    uncorrelated within a key, and its spreads are those of one side times the
    rows of the other. Null keys join with nothing."""
    def side(df: DataFrame, v: str, p: str) -> DataFrame:
        rows = df.select(key, F.col(v).cast("double").alias("v")).where(_counted(F.col("v")) & F.col(key).isNotNull())
        rows = rows.select(key, "v", _origin(rows, "v", None).alias("at"))
        d = F.col("v") - F.col("at")
        return rows.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{p}"), F.max("at").alias(f"at_{p}"),
                                     F.avg(d).alias(f"mean_{p}"), F.var_pop(d).alias(f"var_{p}"))

    n = F.col("n_x") * F.col("n_y")
    return side(h, x, "x").join(side(t, y, "y"), key).select(
        key, n.alias("n"), "at_x", "at_y", "mean_x", "mean_y", (F.col("var_x") * n).alias("cxx"),
        (F.col("var_y") * n).alias("cyy"), F.lit(0.0).alias("cxy"))


def merge_states(states: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One state per group from any number of states. Means are taken relative
    to a reference near them (an origin and a mean from the middle of the group), so
    what is squared is the spread between states, not the offset. ``states`` is
    read twice: give a written table."""
    near = [_middle(c).alias(c) for c in ("at_x", "at_y", "mean_x", "mean_y")]
    if by:
        ref = states.groupBy(*by).agg(F.struct(*near).alias("ref"))
        ref = ref.select("ref", *[F.col(c).alias(f"_{c}") for c in by])
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        rows = states.join(ref, same)
    else:
        rows = states.withColumn("ref", states.agg(F.struct(*near)).scalar())
    n = F.col("n").cast("double")

    def away(v: str) -> Column:
        return (F.col(f"at_{v}") - F.col(f"ref.at_{v}")) + (F.col(f"mean_{v}") - F.col(f"ref.mean_{v}"))

    rows = rows.select(*by, "n", "ref", away("x").alias("dx"), away("y").alias("dy"), "cxx", "cyy", "cxy")
    dx, dy = F.col("dx"), F.col("dy")
    sums = rows.groupBy(*by).agg(
        F.sum("n").alias("n"), F.max("ref").alias("ref"), F.sum(n * dx).alias("sx"), F.sum(n * dy).alias("sy"),
        F.sum(F.col("cxx") + n * dx * dx).alias("sxx"), F.sum(F.col("cyy") + n * dy * dy).alias("syy"),
        F.sum(F.col("cxy") + n * dx * dy).alias("sxy"))

    def centred(s: str, a: str, b: str) -> Column:
        return F.col(s) - F.col(a) * F.col(b) / n

    return sums.where(n > 0).select(
        *by, "n", F.col("ref.at_x").alias("at_x"), F.col("ref.at_y").alias("at_y"),
        (F.col("ref.mean_x") + F.col("sx") / n).alias("mean_x"), (F.col("ref.mean_y") + F.col("sy") / n).alias("mean_y"),
        F.greatest(centred("sxx", "sx", "sx"), F.lit(0.0)).alias("cxx"),
        F.greatest(centred("syy", "sy", "sy"), F.lit(0.0)).alias("cyy"), centred("sxy", "sx", "sy").alias("cxy"))


def r_of() -> Column:
    """Pearson's r of a state."""
    return ieee_div(F.col("cxy"), F.sqrt("cxx") * F.sqrt("cyy"))


def pair_correlation(h: DataFrame, t: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """``(rows, r)`` over the joined rows of two pair tables; no row if nothing joins."""
    merged = merge_states(cut(pair_states(h, t, x, y, key), "pair-states"))
    return merged.select(F.col("n").alias("rows"), r_of().alias("r"))


def store_states(states: DataFrame, path: str, batch: str) -> None:
    """Put the states of some batches (column ``batch``) into the store at
    ``path``. A batch that is there already is replaced, so a batch may be
    delivered twice, or a failed run repeated."""
    (states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(batch).parquet(path))


def stored_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
