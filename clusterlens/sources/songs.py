"""Song-record CSV lines.

The record is a quoted CSV line of 34 positional fields. ``song_lines``
derives such lines from ``lineitem`` joined to ``part`` so that the parser,
the pair join and the correlations run over data that grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.sources.tables import table


def read_song_lines(spark: SparkSession, path: str) -> DataFrame:
    """Song CSV files (no header) as ``value`` lines."""
    return spark.read.text(path)


def song_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quoted CSV line per lineitem row (``value``).

    Mapping: artist7Id = suppkey, artistId = 'AR'+suppkey, artistName =
    "Artist, <suppkey>" (quoted, holds a comma), artistPlaymeId = suppkey-50,
    danceability = discount, duration = quantity, endOfFadeIn = tax,
    songHotness = discount (the text 'nan' on line number 6), startOfFadeOut =
    quantity/2, tempo = tax*1000, title = quoted part name, trackId = partkey,
    track7Id = 'TR'+orderkey+'-'+linenumber, year = ship year. Other numbers
    are '0' and other strings empty. Line number 7 loses its last field.

    The join with ``part`` is left to the planner: broadcast only when the
    part side's estimated size is under the broadcast threshold, otherwise a
    sort-merge join on partkey.
    """
    li = table(spark, sf_dir, "lineitem", spread_out=True).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_discount", "l_tax", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    j = li.join(part, li.l_partkey == part.p_partkey, "inner")

    def s(c):
        return F.col(c).cast("string")

    zero, empty = F.lit("0"), F.lit("")
    supp = s("l_suppkey")
    hot = F.when(F.col("l_linenumber") == 6, F.lit("nan")).otherwise(s("l_discount"))
    fields = [
        zero, supp, zero, zero, F.concat(F.lit("AR"), supp), zero, empty, zero, empty,
        F.concat(F.lit('"Artist, '), supp, F.lit('"')),
        (F.col("l_suppkey") - 50).cast("string"), empty,
        s("l_discount"), s("l_quantity"), s("l_tax"), zero, zero, zero, zero, zero, zero,
        empty, empty, zero, hot, empty,
        (F.col("l_quantity") / 2).cast("string"), (F.col("l_tax") * 1000).cast("string"),
        zero, zero, F.concat(F.lit('"'), F.col("p_name"), F.lit('"')), s("l_partkey"),
        F.concat(F.lit("TR"), s("l_orderkey"), F.lit("-"), s("l_linenumber")),
    ]
    year = F.year(F.col("l_shipdate")).cast("string")
    body = F.concat_ws(",", *fields)
    line = F.when(F.col("l_linenumber") == 7, body).otherwise(F.concat_ws(",", body, year))
    return j.select(line.alias("value"))
