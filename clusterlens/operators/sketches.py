"""Mergeable sketches beside the exact operators: quantiles (KLL), distinct
counts (HyperLogLog) and frequent values (frequent items).

A sketch is a bounded state per group and batch. States are stored by batch
and united later, so a report over a year reads a row per group and day, not the
tasks or words. All three are built-in aggregates with map-side combining: a
group with a third of all rows moves as one state per task.

Defined results: nulls are not counted; a group of nulls only has no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUANTILE_K = 800  # size of a quantile state; its error falls about as 1 / k
DISTINCT_LG_K = 14  # 2^14 registers
FREQUENT_ITEMS = 16_384  # values tracked by a frequency state


def rank_error(k: int = QUANTILE_K) -> float:
    """Bound on |rank of the answer - rank asked|: twice the error that a KLL
    sketch of size ``k`` keeps in 99 % of answers."""
    return 2 * 2.296 / k ** 0.9723


def quantile_states(rows: DataFrame, value: str, by: tuple[str, ...], k: int = QUANTILE_K) -> DataFrame:
    """``(by, n, sketch)`` of a whole-number column."""
    v = F.col(value).cast("bigint")
    return rows.where(v.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint(v, k).alias("sketch"))


def merge_quantiles(states: DataFrame, by: tuple[str, ...], k: int = QUANTILE_K) -> DataFrame:
    return states.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", k).alias("sketch"))


def quantiles(states: DataFrame, by: tuple[str, ...], at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """``(by, n, q, value)``: a row for each quantile asked for."""
    answers = F.array(*[F.struct(F.lit(q).alias("q"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).alias("value"))
                        for q in at])
    return states.select(*by, "n", F.inline(answers))


def quantile_ranks(rows: DataFrame, value: str, answers: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``(by, n, q, value, low, high)``: the shares of a group's rows below an
    answer and not above it, by an exact count (one row per group is joined to
    the rows, all its answers as columns of an array)."""
    asked = answers.groupBy(*by).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("q", "value"))).alias("a"))
    counted = (rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v")).join(asked, list(by))
               .select(*by, "n", "v", F.inline("a")))
    return counted.groupBy(*by, "n", "q", "value").agg(
        (F.count_if(F.col("v") < F.col("value")) / F.col("n")).alias("low"),
        (F.count_if(F.col("v") <= F.col("value")) / F.col("n")).alias("high"))


def distinct_error(lg_k: int = DISTINCT_LG_K) -> float:
    """Four standard errors of a distinct count, as a share of it."""
    return 4 * 1.04 / 2 ** (lg_k / 2)


def distinct_states(rows: DataFrame, value: str, by: tuple[str, ...] = (), lg_k: int = DISTINCT_LG_K) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.hll_sketch_agg(value, lg_k).alias("sketch"))


def merge_distinct(states: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return states.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_estimate(states: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return states.select(*by, F.hll_sketch_estimate("sketch").alias("estimate"))


def frequent_states(rows: DataFrame, value: str, by: tuple[str, ...] = (), items: int = FREQUENT_ITEMS) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k_accumulate(`{value}`, {items})").alias("sketch"))


def merge_frequent(states: DataFrame, by: tuple[str, ...] = (), items: int = FREQUENT_ITEMS) -> DataFrame:
    return states.groupBy(*by).agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_combine(sketch, {items})").alias("sketch"))


def frequent_values(states: DataFrame, share: float, items: int = FREQUENT_ITEMS) -> DataFrame:
    """``(value, estimate)``: every value that holds at least ``share`` of the
    rows of a state, perhaps with a few that hold a little less. A state of
    ``items`` errs by less than 4 / items of its rows, so the share asked for must
    be above that."""
    if share <= 4 / items:
        raise ValueError(f"a state of {items} items cannot answer a share of {share}")
    top = F.expr(f"approx_top_k_estimate(sketch, {int(2 / share) + 1})")
    found = states.select("n", F.inline(top))
    return (found.where(F.col("count") + F.col("n") * (4 / items) >= F.col("n") * share)
            .select(F.col("item").alias("value"), F.col("count").alias("estimate")))
