"""Operator 6: quality rules kept as a bitmask ledger.

Every rule is evaluated once per document. The ledger stores the measurements
and one bit per rule in ``failures`` (bit set: the document fails that rule).
A policy is a named, versioned bit mask; applying it is one bitwise test, so a
new policy version never reads the texts again. Ablations ask, for each rule
of a policy, how many documents it fails, how many only it removes, and how
many would be kept without it: all of that follows from the counts of the
distinct bit patterns (at most 2^rules rows), found with map-side combining.

Measurements come from NumPy over Arrow batches (``words.py``); no row leaves
its task, there is no shuffle, and a batch is worked through in bounded blocks.

Defined results: a null or empty text has no words, all measurements are 0 and
it fails ``few_words``; repeated rows are judged each for itself; an empty
table gives an empty ledger; further columns of the input pass through, except
those named like a ledger column, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterlens.llm import shared
from clusterlens.llm import words as W
from clusterlens.sources.tables import table

SYMBOLS = b"#*$%&|<>"  # fixed value: the symbols counted
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class Rule:
    """A rule: its bit, name and the condition under which a document fails."""

    bit: int
    name: str
    fails: Column | str  # SQL over the measurement columns


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document is kept when it fails none."""

    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...]) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[x] for x in set(self.rules))


# Production rules. The first two are the base that every policy includes.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "short_words", "10 * word_chars < 20 * n_words"),
    Rule(5, "long_words", "10 * word_chars > 120 * n_words"),
)
BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 2, ("few_words", "repeated_windows", "symbols", "duplicate_lines",
                                  "short_words", "long_words"))


def measure_block(b: W.Block, plain: W.SpanHash) -> list[np.ndarray]:
    """The MEASURES of each row of a block (n_lines: lines with a word)."""
    n = len(b)
    ws, we, wr = W.words(b)
    n_words = W.per_row(wr, n)
    ink = ~W.IS_WHITE[b.data] & ((b.data & 0xC0) != 0x80)
    at = np.flatnonzero(ink)
    word_chars = W.per_row(W.row_of(b, at), n)
    at = np.flatnonzero(_IS_SYMBOL[b.data])
    n_symbols = W.per_row(W.row_of(b, at), n)

    ls, le, lr = W.lines(b)
    has_word = np.searchsorted(ws, ls) < np.searchsorted(ws, le)
    ls, le, lr = ls[has_word], le[has_word], lr[has_word]
    dup = _seen_before(plain(b.data, ls, le), lr)
    n_dup_lines = W.per_row(lr[dup], n)

    wh, first = W.windows(plain(b.data, ws, we), wr, WINDOW)
    twice = first[_repeated(wh, wr[first])] if len(first) else first
    cover = np.zeros(len(ws) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    hit = np.cumsum(cover[:-1]) > 0
    n_repeat = W.per_row(wr[hit], n)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat, W.per_row(lr, n)]


def _order(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that brings equal (row, hash) together, and whether each
    entry of that order equals the one before."""
    order = np.lexsort((h, rows))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    return order, same


def _seen_before(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    order, same = _order(h, rows)
    out = np.zeros(len(h), bool)
    out[order] = same
    return out


def _repeated(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    order, same = _order(h, rows)
    both = same.copy()
    both[:-1] |= same[1:]
    out = np.zeros(len(h), bool)
    out[order] = both
    return out


def measured(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the MEASURES columns; ``keep_text`` false drops the text."""
    keep = [c for c in docs.columns if c.lower() not in MEASURES]
    docs = docs.select(*keep)
    out = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = T.StructType(out + [T.StructField(m, T.LongType()) for m in MEASURES])
    names = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = W.SpanHash(0)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for b in W.blocks(column):
                part = batch.slice(b.first, len(b))
                values = measure_block(b, plain)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in names] + [pa.array(v) for v in values],
                    names=names + list(MEASURES))

    return docs.mapInArrow(run, schema)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text",
           keep_text: bool = True) -> DataFrame:
    """Measurements plus ``failures`` (bigint, one bit per failed rule)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "failures"])
    bits = F.lit(0).cast("bigint")
    for r in rules:
        fails = F.expr(r.fails) if isinstance(r.fails, str) else r.fails
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << r.bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return measured(docs, text, keep_text).withColumn("failures", bits)


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a ledger row is kept under the policy (one bitwise test)."""
    return F.col("failures").bitwiseAND(F.lit(policy.mask(rules)).cast("bigint")) == 0


def ablation(led: DataFrame, policies: tuple[Policy, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(policy, version, rule, n_docs, n_failed, n_removed, n_only, n_kept_without)
    for each rule of each policy, from the counts of the ledger's bit patterns."""
    spark = led.sparkSession
    patterns = led.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    names = {r.name: r.bit for r in rules}
    spec = [(p.name, p.version, x, p.mask(rules), 1 << names[x]) for p in policies for x in sorted(set(p.rules))]
    probe = F.array(*[F.struct(F.lit(a).alias("policy"), F.lit(v).alias("version"), F.lit(x).alias("rule"),
                               F.lit(m).cast("bigint").alias("m"), F.lit(bit).cast("bigint").alias("b"))
                      for a, v, x, m, bit in spec]) if spec else None
    if probe is None:
        return spark.createDataFrame([], "policy string, version int, rule string, n_docs long, n_failed long, "
                                         "n_removed long, n_only long, n_kept_without long")
    rows = patterns.select("failures", "n", F.explode(probe).alias("p")).select("failures", "n", "p.*")
    hit = F.col("failures").bitwiseAND(F.col("m"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("bigint"))
    return rows.groupBy("policy", "version", "rule").agg(
        F.sum("n").alias("n_docs"),
        count(F.col("failures").bitwiseAND(F.col("b")) != 0).alias("n_failed"),
        count(hit != 0).alias("n_removed"),
        count(hit == F.col("b")).alias("n_only"),
        count(hit.bitwiseAND(F.bitwise_not(F.col("b"))) == 0).alias("n_kept_without"))


def keep_passing(docs: DataFrame, policy: Policy = STANDARD, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that the policy keeps, with their own columns."""
    led = ledger(shared.packed(docs, text=F.col("text")), rules, keep_text=False)
    return led.where(passes(policy, rules)).select("row.*")


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule ledger of every whole text of ``documents`` under the standard policy."""
    led = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      (~passes(BASE)).alias("base_failed"), passes(STANDARD).alias("kept"), "n_lines", "failures")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, t, ws, ls,
        list_transform(range(1, greatest(len(ws) - 3, 1)), lambda i: list_slice(ws, i, i + 4)) AS win FROM w),
u AS (SELECT doc_id, unnest(win) AS win, unnest(range(1, len(win) + 1)) AS i FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM u),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r WHERE n > 1) GROUP BY doc_id),
m AS (SELECT g.doc_id, len(ws)::BIGINT AS n_words,
        length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
      FROM g LEFT JOIN c ON g.doc_id = c.doc_id),
f AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
        + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
        + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN 10 * word_chars < 20 * n_words THEN 16 ELSE 0 END)
        + (CASE WHEN 10 * word_chars > 120 * n_words THEN 32 ELSE 0 END) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failures & 3) <> 0 AS base_failed, (failures & 63) = 0 AS kept, n_lines, failures::BIGINT AS failures
FROM f
"""
