"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Escape character for the comma placeholder below.
_ESC = "\u0001"


def quoted_csv_split(line: Column) -> Column:
    """Split a quoted CSV line into fields and drop every double quote.

    A comma separates fields when an even number of quotes follows it up to
    the end of the line (limit -1: empty fields kept). Instead of a
    look-ahead regex (quadratic in the line length) the line is cut at its
    quotes: a comma in the piece ``j`` places from the end has ``j`` quotes
    after it, so commas in pieces with odd ``j`` are literal. They are
    swapped for a placeholder, the pieces re-joined (which drops the quotes),
    the result split on the remaining commas and the placeholder swapped
    back. The placeholder is collision-free: the escape character itself is
    first doubled into ``ESC a`` and the placeholder is ``ESC b``.
    Linear in the line length, and built-in expressions only; lines without
    quotes take a plain split.
    """
    esc, lit_comma = F.lit(_ESC + "a"), F.lit(_ESC + "b")
    pieces = F.reverse(F.split(F.replace(line, F.lit(_ESC), esc), '"', -1))
    marked = F.transform(pieces, lambda p, j: F.when(j % 2 == 1, F.replace(p, F.lit(","), lit_comma))
                         .otherwise(p))
    fields = F.split(F.array_join(F.reverse(marked), ""), ",", -1)
    quoted = F.transform(fields, lambda x: F.replace(F.replace(x, lit_comma, F.lit(",")), esc, F.lit(_ESC)))
    # without quotes every comma separates: a plain split gives the same fields
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, ",", -1))


def short_host(host: Column) -> Column:
    """Host name up to the first dot (an IP address keeps its first octet)."""
    return F.split_part(host, F.lit("."), F.lit(1))
