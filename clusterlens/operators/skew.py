"""Joins on a key that may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def salted_join(rows: DataFrame, key: str, values: DataFrame, by: list[Column]) -> DataFrame:
    """Inner join of ``rows`` with ``values`` (unique ``key``) on (key, salt): a
    row's salt is a hash of ``by``, and a value goes only to the salts that its
    key's rows have (found by a map-side combined aggregate)."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)))
    uses = salted.groupBy(key, "_salt").agg(F.lit(True).alias("_used")).drop("_used")
    return salted.join(uses.join(values, key), [key, "_salt"]).drop("_salt")
