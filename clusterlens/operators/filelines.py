"""Rows that depend on earlier rows of their file, over files of any size.

Input: ``(file, block, pos, value)`` lines (``sources/filelines.py``). Lines
are shuffled once, by (file, block); a block is one split, so a window over it
is bounded however long the file is. What passes from block to block (the last
header, the record still open) is found on a table with one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = ["file", "block"]


def _within() -> Window:
    return Window.partitionBy(*_BLOCK).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def _blocks_before() -> Window:
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def with_last_above(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """``lines`` and, as ``name``, the last non-null ``value`` at or above each
    line in its file (null when there is none)."""
    own = lines.withColumn("_own", value)
    ends = own.groupBy(*_BLOCK).agg(F.max(F.when(F.col("_own").isNotNull(), F.struct("pos", "_own"))).alias("_end"))
    carried = ends.select(*_BLOCK, F.last("_end", ignorenulls=True).over(_blocks_before()).alias("_carried"))
    here = own.withColumn("_here", F.last("_own", ignorenulls=True).over(_within()))
    joined = here.join(carried, _BLOCK)
    return (joined.withColumn(name, F.coalesce("_here", F.col("_carried")["_own"]))
            .drop("_own", "_here", "_carried"))


def _pieces(lines: DataFrame, is_start: Column) -> DataFrame:
    """One row per record and block: its number in the block (0: lines above
    the block's first start), first line, and further lines in order."""
    start = F.coalesce(is_start, F.lit(False))
    numbered = lines.withColumn("_start", start).withColumn(
        "rec", F.sum(F.col("_start").cast("bigint")).over(_within()))
    more = F.sort_array(F.collect_list(F.when(~F.col("_start"), F.struct("pos", "value"))))
    return numbered.groupBy(*_BLOCK, "rec").agg(F.max(F.when(F.col("_start"), F.col("value"))).alias("head"),
                                                more.alias("more"))


def _owners(lines: DataFrame, is_start: Column) -> DataFrame:
    """For each block, the record open at its start: ``(owner, owner_rec)``, and
    how many blocks back its first line lies."""
    blocks = lines.groupBy(*_BLOCK).agg(F.count_if(is_start).alias("n"))
    blocks = blocks.withColumn("at", F.row_number().over(Window.partitionBy("file").orderBy("block")))
    open_rec = F.when(F.col("n") > 0, F.struct("block", "n", "at"))
    blocks = blocks.withColumn("open", F.last(open_rec, ignorenulls=True).over(_blocks_before()))
    return blocks.select(*_BLOCK, F.col("open")["block"].alias("owner"), F.col("open")["n"].alias("owner_rec"),
                         (F.col("at") - F.col("open")["at"]).alias("back"))


def _above(lines: DataFrame, is_start: Column) -> DataFrame:
    tops = _pieces(lines, is_start).where(F.col("rec") == 0)
    return tops.join(_owners(lines, is_start), _BLOCK)


def records(lines: DataFrame, is_start: Column, max_blocks: int = 8) -> DataFrame:
    """``(file, block, rec, value)``: records of one or more lines, joined by a
    line break. A record starts at a line for which ``is_start`` holds and takes
    the lines below it up to the next start, also over the ends of splits. Its
    text is one value in one task, so it may reach ``max_blocks`` blocks beyond
    the one it starts in; lines further down, and lines above a file's first
    start, are rows of ``lines_outside``, so nothing is lost."""
    pieces = _pieces(lines, is_start).where(F.col("rec") > 0)
    tails = _above(lines, is_start).where(F.col("owner").isNotNull() & (F.col("back") <= max_blocks))
    tails = (tails.groupBy("file", F.col("owner").alias("block"), F.col("owner_rec").alias("rec"))
             .agg(F.sort_array(F.collect_list(F.struct("back", "more"))).alias("tail")))
    rest = F.concat(F.col("more")["value"], F.coalesce(F.flatten(F.col("tail")["more"])["value"],
                                                       F.array().cast("array<string>")))
    whole = pieces.join(tails, [*_BLOCK, "rec"], "left")
    return whole.select(*_BLOCK, "rec", F.array_join(F.concat(F.array("head"), rest), "\n").alias("value"))


def lines_outside(lines: DataFrame, is_start: Column, max_blocks: int = 8) -> DataFrame:
    """``(file, block, pos, value)``: lines that belong to no record."""
    outside = F.col("owner").isNull() | (F.col("back") > max_blocks)
    return _above(lines, is_start).where(outside).select(*_BLOCK, F.inline("more"))
