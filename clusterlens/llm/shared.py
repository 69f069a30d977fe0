"""Helpers of this folder: salts for hot groups and written tables.

A group (line, set of copies, bucket) may hold a third of all rows. Rows of a
group therefore carry a salt, a hash of the row's own id, and joins that bring
a group's aggregate back to its rows use (group, salt) as the key. Which salts
a group has is kept as a 64-bit mask, gathered by the same map-side combined
aggregation as the aggregate itself; a small group has few salts, so the table
to join never has more rows than the group's members.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.session import shared_dir

SALTS = 64


def salt(*cols: Column) -> Column:
    """Salt 0 .. 63 of a row, from its id."""
    return F.pmod(F.xxhash64(F.lit("salt"), *cols), F.lit(SALTS)).cast("int")


def salt_mask(salt_col: str = "salt") -> Column:
    """Aggregate: the set of a group's salts as a bit mask."""
    return F.bit_or(F.expr(f"shiftleft(1L, `{salt_col}`)"))


def by_salt(groups: DataFrame, mask: str = "salts", name: str = "salt") -> DataFrame:
    """One row per salt of each group."""
    has = F.expr(f"filter(sequence(0, {SALTS - 1}), i -> shiftrightunsigned(`{mask}`, i) % 2 != 0)")
    return groups.withColumn(name, F.explode(has)).drop(mask)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to a fresh folder of the shared
    checkpoint folder and read it back. A lost executor then costs a re-read."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    return shared_dir(spark, "llm", f"{name}-{uuid.uuid4().hex}")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns of these names (in any case): a column that
    an operator adds replaces one of the same name in its input."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def lookup(rows: DataFrame, key: str, values: DataFrame, row_id: str, how: str = "left") -> DataFrame:
    """``rows`` joined with ``values`` (one row per ``key``) where one key may
    hold a large part of the rows: a value goes to each salt its rows have."""
    salted = rows.withColumn("_salt", salt(F.col(row_id)))
    masks = salted.groupBy(key).agg(salt_mask("_salt").alias("_salts"))
    spread = by_salt(masks.join(values, key), "_salts", "_salt")
    return salted.join(spread, [key, "_salt"], how).drop("_salt")


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """``df`` as one struct column ``row`` beside the columns ``more``, so that
    no column of the input can clash with an operator's; undone by ``row.*``."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     *[c.alias(name) for name, c in more.items()])


def without_ids(df: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not among the ids of ``gone`` (id)."""
    return packed(df, id=key).join(gone.select("id").distinct(), "id", "left_anti").select("row.*")
