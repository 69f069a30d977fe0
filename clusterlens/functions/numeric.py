"""Numeric helpers with JVM/IEEE semantics.

Spark 4 runs with ANSI mode on: ``x / 0.0`` raises and ``try_divide`` gives
NULL, while the workloads we reproduce use IEEE doubles (Inf / NaN). The
helpers below give IEEE results without turning ANSI off for the session.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _nan() -> Column:
    return F.lit(float("nan"))


def _inf() -> Column:
    return F.lit(float("inf"))


def ieee_div(a: Column, b: Column) -> Column:
    """IEEE-754 double division: x/0 is +-Inf, 0/0 and NaN/0 are NaN."""
    a = a.cast("double")
    b = b.cast("double")
    return (F.when(b != 0, a / b)
            .when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
            .when((a == 0) | F.isnan(a), _nan())
            .when(a > 0, _inf())
            .otherwise(-_inf()))


def java_int(s: Column) -> Column:
    """``Integer.parseInt`` with 0 on failure: optional sign and ASCII digits,
    no trimming, 32-bit range. A text that is the number as it is printed needs
    no further look."""
    i = s.try_cast("int")
    return (F.when(i.isNull(), F.lit(0))
            .when((i.cast("string") == s) | s.rlike(r"^[+-]?[0-9]+\z"), i)
            .otherwise(F.lit(0)))


_TRIMMED = r"[\x00-\x20]*"  # the JVM trims U+0000 .. U+0020
_NOT_JAVA = (rf"^(?!{_TRIMMED}[+-]?(?:NaN|Infinity){_TRIMMED}\z)"
             rf"(?i:{_TRIMMED}[+-]?(?:nan|inf|infinity){_TRIMMED}\z)")


def java_double(s: Column) -> Column:
    """``Double.parseDouble`` with 0.0 on failure.

    Spark's cast (which trims like the JVM parser) agrees with it except for
    the special literals: Spark also accepts lower-case ``nan``/``inf``/
    ``infinity``, the JVM only ``NaN`` and ``Infinity`` (optionally signed)
    exactly cased. The text check therefore runs only on the rare
    NaN/Infinity results; it is one pattern, as a record has many numbers and the
    code of a row must stay small enough to be compiled.
    """
    d = s.try_cast("double")
    return (F.when(F.abs(d) < _inf(), d)
            .when(d.isNull() | s.rlike(_NOT_JAVA), F.lit(0.0))
            .otherwise(d))


def pearson(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column, syy: Column) -> Column:
    """``(n*Sxy - Sx*Sy) / (sqrt(n*Sxx - Sx^2) * sqrt(n*Syy - Sy^2))`` with
    IEEE division and NaN for the square root of a negative number."""
    n = n.cast("double")
    num = n * sxy - sx * sy
    vx = n * sxx - sx * sx
    vy = n * syy - sy * sy
    den = F.when(vx < 0, _nan()).otherwise(F.sqrt(vx)) * F.when(vy < 0, _nan()).otherwise(F.sqrt(vy))
    return ieee_div(num, den)


def round_sig(x: Column, digits: int = 10) -> Column:
    """Round a double to ``digits`` significant digits (via ``%.Ne`` text and
    back), so that float sums computed in different orders compare equal.
    NaN and +-Inf pass through."""
    return F.format_string(f"%.{digits - 1}e", x.cast("double")).cast("double")
