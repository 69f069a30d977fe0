"""Tokenising with JVM ``String.split`` semantics, and line splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word-delimiter class used by the word-count workload,
# and its characters. Comma, '!', apostrophe, hyphen and tab are
# deliberately NOT delimiters.
WORD_DELIMITERS = '[ .;:()?"]+'
WORD_DELIMITER_CHARS = ' .;:()?"'

# Hadoop's line reader ends a line at \r\n, \n or \r.
LINE_BREAK = "\r\n|\n|\r"


def java_split(col: Column, pattern: str, strip_chars: str | None = None) -> Column:
    """``str.split(pattern)`` as the JVM does it (limit 0).

    * a leading delimiter yields a leading empty token,
    * trailing empty tokens are dropped,
    * the empty string yields ``['']``,
    * a string made only of delimiters yields ``[]``.

    Spark's ``split`` keeps trailing empties for any limit, so the trailing
    delimiters are stripped first (``\\z`` = true end of input). When the
    pattern is a run of single characters, pass them as ``strip_chars``: the
    strip is then an ``rtrim`` of those characters instead of a regex pass
    over the whole string.
    """
    if strip_chars is not None:
        stripped = F.rtrim(col, F.lit(strip_chars))
    else:
        stripped = F.regexp_replace(col, f"(?:{pattern})+\\z", "")
    return (F.when(col == "", F.array(F.lit("")))
            .when(stripped == "", F.array().cast("array<string>"))
            .otherwise(F.split(stripped, pattern, -1)))


def split_lines(text: Column) -> Column:
    """Lines of a text as a file reader would see them.

    One final line break adds no line; an empty text has no lines.
    """
    n = F.length(text)
    body = (F.when(text.endswith("\r\n"), text.substr(F.lit(1), n - 2))
            .when(text.endswith("\n") | text.endswith("\r"), text.substr(F.lit(1), n - 1))
            .otherwise(text))
    return (F.when(text == "", F.array().cast("array<string>"))
            .otherwise(F.split(body, LINE_BREAK, -1)))
