"""Global row order without an un-partitioned window.

Rows are dealt to ranges of the order columns whose bounds are the same in
every evaluation: they come from the BOUNDS_SAMPLE rows with the smallest hash
of the order columns, a uniform sample that depends on the rows alone (not on
partitioning, task order or retries). Each branch of a plan that computes
a row's range therefore gets the same one, whether or not Spark reuses an
exchange. Within a range rows are numbered by an ordinary window; a table
with one row per range (bounded by the number of ranges, so it is broadcast)
adds what lies in earlier ranges and, for ``with_next``, the next range's
first value.

The order must be unique: the order columns together identify a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clusterlens.sources.materialize import cut

BOUNDS_SAMPLE = 10_000


def _order(cols: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def range_bounds(df: DataFrame, order_cols: list[str], ranges: int) -> Column:
    """Scalar subquery: at most ``ranges - 1`` ascending bounds."""
    key = _order(order_cols)
    sample = (df.select(key.alias("k"), F.xxhash64(*[F.col(c) for c in order_cols]).alias("h"))
              .orderBy("h", "k").limit(BOUNDS_SAMPLE))
    ks = sample.agg(F.sort_array(F.collect_list("k")).alias("ks"))
    picks = F.sequence(F.lit(1), F.lit(max(ranges - 1, 1)))
    at = F.transform(picks, lambda i: F.floor(i * F.size("ks") / F.lit(max(ranges, 2))).cast("int"))
    bounds = F.filter(F.transform(at, lambda i: F.get(F.col("ks"), i)), lambda b: b.isNotNull())
    return ks.select(F.array_distinct(bounds).alias("bounds")).scalar()


def range_number(bounds: Column, key: Column, ranges: int) -> Column:
    """How many of the ascending ``bounds`` are at or below ``key``: a binary
    search, about log2(ranges) comparisons."""
    strides = F.array(*[F.lit(1 << i) for i in reversed(range(max(ranges, 1).bit_length()))])
    return F.aggregate(strides, F.lit(0), lambda at, stride: F.when(
        F.get(bounds, at + stride - 1) <= key, at + stride).otherwise(at))


def default_ranges(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_of(df: DataFrame, order_cols: list[str], ranges: int | None = None, name: str = "_range") -> DataFrame:
    """``df`` with the number of its range: how many bounds are at or below the row."""
    n = ranges or default_ranges(df)
    out = df.withColumn("_bounds", range_bounds(df, order_cols, n)).withColumn("_key", _order(order_cols))
    return out.withColumn(name, range_number(F.col("_bounds"), F.col("_key"), n)).drop("_bounds", "_key")


def global_position(df: DataFrame, order_cols: list[str], name: str = "pos",
                    partitions: int | None = None) -> DataFrame:
    """``df`` with the 0-based position of each row in the order."""
    rows = range_of(df, order_cols, partitions)
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order_cols)) - 1
    out = rows.withColumn("_local", local).join(F.broadcast(offsets), "_range")
    return out.withColumn(name, F.col("_before") + F.col("_local")).drop("_range", "_before", "_local")


def _with_offsets(rows: DataFrame, offsets: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the offsets of their range and group (a null group is a group)."""
    named = offsets.withColumnsRenamed({c: f"_of{c}" for c in ["_range", *by]})
    same = F.col("_range") == F.col("_of_range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of{c}"))
    return rows.join(named, same, how).drop(*[f"_of{c}" for c in ["_range", *by]])


def with_next(df: DataFrame, order_cols: list[str], value: str, next_name: str,
              by: list[str] | None = None) -> DataFrame:
    """``df`` with the 0-based position ``pos`` and the next row's ``value`` in
    the order (NULL for the last row), within each group of ``by``. Groups are dealt to ranges
    like rows, so one that holds all rows spans all ranges; the table of offsets has a row per
    range and group."""
    by = by or []
    rows = range_of(df, [*by, *order_cols])
    key = _order(order_cols)
    ranges = rows.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_n"),
                                             F.min_by(F.col(value), key).alias("_first"))
    along = Window.partitionBy(*by).orderBy("_range") if by else Window.orderBy("_range")
    before = F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranges.select("_range", *by, F.coalesce(before, F.lit(0).cast("bigint")).alias("_before"),
                            F.lead("_first").over(along).alias("_then"))
    w = Window.partitionBy("_range", *by).orderBy(*order_cols)
    out = rows.withColumn("_local", F.row_number().over(w) - 1).withColumn("_lead", F.lead(value).over(w))
    out = out.withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    out = _with_offsets(out, offsets, by) if by else out.join(F.broadcast(offsets), "_range")
    return out.select(*[F.col(c) for c in df.columns], (F.col("_before") + F.col("_local")).alias("pos"),
                      F.when(F.col("_last"), F.col("_then")).otherwise(F.col("_lead")).alias(next_name))


def running_sum(df: DataFrame, by: str, order: str, value: str, name: str, next_name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group ``by`` up to and with
    this one in ``order`` (unique in the group), and the next row's ``order``
    (NULL for the last). A distributed prefix sum: ranges of (by, order) are summed on their own,
    and a table adds what lies before. Only a group with a bound inside lies in several ranges,
    at most two such groups in each, so that table is bounded by the ranges, not by the groups."""
    n, key = default_ranges(df), [by, order]
    rows = df.withColumn("_bounds", range_bounds(df, key, n)).withColumn("_key", _order(key))
    rows = rows.withColumn("_range", range_number(F.col("_bounds"), F.col("_key"), n))
    # a bound inside the group is next to the row, or another of the group is
    near = [F.get("_bounds", at)[by].eqNullSafe(F.col(by)) for at in (F.col("_range") - 1, F.col("_range"))]
    rows = cut(rows.withColumn("_split", near[0] | near[1]).drop("_bounds", "_key"), "ranges")  # read twice
    totals = rows.where("_split").groupBy("_range", by).agg(F.sum(value).alias("_total"), F.min(order).alias("_first"))
    along = Window.partitionBy(by).orderBy("_range")
    offsets = totals.select("_range", by, (F.sum("_total").over(along) - F.col("_total")).alias("_before"),
                            F.lead("_first").over(along).alias("_then"))
    w = Window.partitionBy("_range", by).orderBy(order)
    up_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({"_sum": F.sum(value).over(up_to), "_lead": F.lead(order).over(w)})
    out = _with_offsets(out, F.broadcast(offsets), [by], "left")
    return out.select(*[F.col(c) for c in df.columns],
                      (F.coalesce("_before", F.lit(0)) + F.col("_sum")).alias(name),
                      F.coalesce("_lead", "_then").alias(next_name))


BINS = 4096


def _time_layout(rows: DataFrame, at: str, ranges: int) -> Column:
    """Scalar subquery: how to deal the times ``at`` (numbers) to ranges of about
    equally many rows. (lo, width: of BINS equal bins; of: the range of each bin;
    salts: how many tasks share each range, one per 1/``ranges`` of the rows, so
    a hot second is split.) One row and BINS numbers, whatever the input holds."""
    t = rows.where(F.col(at).isNotNull()).select(F.col(at).alias("t"))
    ends = t.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    ends = ends.select("lo", F.greatest((F.col("hi") - F.col("lo")) / BINS, F.lit(1e-9)).alias("width")).select(
        F.struct("lo", "width").alias("ends")).scalar()
    bins = t.withColumn("e", ends).groupBy(_bin("t", "e").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    along = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = rows.sparkSession.range(0, BINS, 1, 1).select(F.col("id").alias("bin")).join(bins, "bin", "left")
    bins = bins.select("bin", F.coalesce("n", F.lit(0)).alias("n")).withColumn("cum", F.sum("n").over(along))
    total = F.max("cum").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    of = F.floor((F.col("cum") - F.col("n")) * ranges / F.greatest(total, F.lit(1))).cast("int")
    bins = bins.select("bin", "n", F.least(of, F.lit(ranges - 1)).alias("r"), F.greatest(total, F.lit(1)).alias("total"))
    salts = F.sum("n").over(Window.partitionBy("r")) * ranges / F.col("total")
    bins = bins.withColumn("s", F.greatest(F.ceil(salts), F.lit(1)).cast("int"))
    lists = bins.agg(F.sort_array(F.collect_list(F.struct("bin", "r", "s"))).alias("b"))
    return lists.withColumn("e", ends).select(F.struct("e", F.col("b")["r"].alias("of"), F.col("b")["s"].alias("salts"))).scalar()


def _bin(at: str, ends: str) -> Column:
    b = F.floor((F.col(at) - F.col(ends)["lo"]) / F.col(ends)["width"])
    return F.greatest(F.least(b, F.lit(BINS - 1)), F.lit(0)).cast("bigint")


def last_before(rows: DataFrame, marks: DataFrame, at: str, start: str, carried: list[str]) -> DataFrame:
    """``rows`` with the columns ``carried`` of the mark that last starts at or
    before them (as-of; NULL before the first mark; of marks with one start the
    largest by ``carried``; rows without a time are left out). Rows and marks are dealt to ranges of
    time, shared by salts where a range holds many rows, and sorted together; the last
    mark is carried along, that of earlier ranges from an array with an entry per range.
    A mark goes once to every salt of its range, however long it lasts."""
    layout = _time_layout(rows, at, default_ranges(rows))

    def ranged(df: DataFrame) -> DataFrame:
        out = df.withColumn("_layout", layout).withColumn("_e", F.col("_layout.e"))
        out = out.withColumn("_bin", F.coalesce(_bin("_at", "_e"), F.lit(0)).cast("int"))
        return out.withColumns({"_range": F.coalesce(F.get("_layout.of", F.col("_bin")), F.lit(0)),
                                "_salts": F.coalesce(F.get("_layout.salts", F.col("_bin")), F.lit(1))}).drop("_layout", "_e", "_bin")

    held = marks.where(F.col(start).isNotNull()).groupBy(F.col(start).alias("_at")).agg(
        F.max(F.struct(*[F.col(c) for c in carried])).alias("_mark"))
    held = ranged(held)
    lasts = held.groupBy("_range").agg(F.max_by("_mark", "_at").alias("m")).agg(
        F.sort_array(F.collect_list(F.struct("_range", "m"))).alias("lasts")).select("lasts").scalar()
    own = F.struct(*[F.col(c) for c in rows.columns])
    rows_in = ranged(rows.where(F.col(at).isNotNull()).select(F.col(at).alias("_at"), own.alias("_row")))
    rows_in = rows_in.select("_at", F.lit(1).alias("_kind"), "_row", F.lit(None).cast(held.schema["_mark"].dataType).alias("_mark"),
                             "_range", F.pmod(F.xxhash64("_row"), F.col("_salts")).cast("int").alias("_salt"))
    marks_in = held.select("_at", F.lit(0).alias("_kind"), F.lit(None).cast(rows_in.schema["_row"].dataType).alias("_row"),
                           "_mark", "_range", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    w = Window.partitionBy("_range", "_salt").orderBy("_at", "_kind") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = marks_in.unionByName(rows_in).withColumn("_near", F.last("_mark", ignorenulls=True).over(w)).where("_kind = 1")
    earlier = F.filter("_lasts", lambda r: r["_range"] < F.col("_range"))
    both = both.withColumn("_lasts", lasts).withColumn(
        "_near", F.coalesce("_near", F.when(F.size(earlier) > 0, F.element_at(earlier, -1)["m"])))
    return both.select("_row.*", *[F.col("_near")[c].alias(c) for c in carried])
