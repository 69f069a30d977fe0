"""Text-corpus workload: line count, tokenising, word frequencies, lookup,
top-k, report lines, line grep and character count.

All operators are narrow transformations except ``word_frequency`` (one
hash aggregate with map-side partial aggregation, so a very frequent word
costs one row per map task in the shuffle) and ``top_words`` (per-partition
top-k then one small merge, no global sort).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.functions.text import WORD_DELIMITER_CHARS, WORD_DELIMITERS, java_split

# Defaults of the word-count and grep workloads.
DEFAULT_PARTITIONS = 15
DEFAULT_LOOKUP_WORD = "viva"
DEFAULT_TOP_K = 10
DEFAULT_GREP = "Processing"
REPORT_FORMAT = "%30s : %10d"


def fit_partitions(df: DataFrame, n: int = DEFAULT_PARTITIONS) -> DataFrame:
    """Bring ``df`` to ``n`` partitions: repartition (full shuffle) to grow,
    coalesce (no shuffle) to shrink, unchanged when equal. Rows unchanged."""
    current = df.rdd.getNumPartitions()
    if current < n:
        return df.repartition(n)
    if current > n:
        return df.coalesce(n)
    return df


def line_count(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count(F.lit(1)).alias("lines"))


def words(lines: DataFrame, col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per token of each line (empty tokens included)."""
    return lines.select(*keep, F.explode(java_split(F.col(col), WORD_DELIMITERS, WORD_DELIMITER_CHARS))
                        .alias("word"))


def word_total(word_rows: DataFrame) -> DataFrame:
    return word_rows.agg(F.count(F.lit(1)).alias("words"))


def word_frequency(word_rows: DataFrame) -> DataFrame:
    """``(word, n)``: occurrences per lower-cased word; '' is a word too."""
    return (word_rows.groupBy(F.lower(F.col("word")).alias("word"))
            .agg(F.count(F.lit(1)).alias("n")))


def distinct_words(freq: DataFrame) -> DataFrame:
    return freq.agg(F.count(F.lit(1)).alias("distinct_words"))


def occurrences(freq: DataFrame, word: str = DEFAULT_LOOKUP_WORD) -> DataFrame:
    """Occurrences of one word (case-folded); 0 when absent."""
    return (freq.where(F.col("word") == F.lower(F.lit(word)))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("occurrences"))
            .select(F.lit(word).alias("word"), "occurrences"))


def top_words(freq: DataFrame, k: int = DEFAULT_TOP_K) -> DataFrame:
    """The ``k`` most frequent non-empty words; ties broken by word."""
    return (freq.where(F.col("word") != "")
            .orderBy(F.col("n").desc(), F.col("word").asc())
            .limit(k))


def report_lines(top: DataFrame) -> DataFrame:
    """``'%30s : %10d'`` report line per word (pads, never truncates)."""
    return top.select("word", "n", F.format_string(REPORT_FORMAT, "word", "n").alias("line"))


def grep_count(lines: DataFrame, needle: str = DEFAULT_GREP, col: str = "value") -> DataFrame:
    """Number of lines containing ``needle`` (case-sensitive substring)."""
    return (lines.where(F.col(col).contains(needle))
            .agg(F.count(F.lit(1)).alias("matching_lines")))


def char_count(df: DataFrame, col: str) -> DataFrame:
    """Total number of characters in a text column."""
    return df.agg(F.coalesce(F.sum(F.char_length(F.col(col))), F.lit(0)).cast("bigint").alias("chars"))
