"""Operator 9: language-model scores with stupid backoff, computed relationally.

The model is the corpus itself, bigrams over words, each document scored
against the others: for word w after v in document d

    S(w | v) = c'(v w) / c(v)     if c'(v w) > 0, bigrams of other documents
             = ALPHA * c(w) / N   otherwise
    S(w)     = c(w) / N           for a document's first word

c are counts over all documents, c' = c minus the document's own count, N all
words. A document's score is the sum of log S over its words.

1. Texts are dealt to *blocks* of about BUCKET_WORDS words, by a hash of the row
   number, in one shuffle that the next and the last step share.
2. A block counts its words and bigrams. The counts are shuffled by ranges of
   the keys' hashes: a range is a part of the count table, whose group adds the
   blocks' counts up. A key comes once from a block at most, so ranges are even
   however frequent a word is, and copies of a text in a block cost nothing. N
   is the total of a key of its own.
3. The totals go back to their blocks, in the order in which the block sent its
   keys, and are cogrouped with the block's texts, which look them up; sums per
   text are summed per document.

Nothing is broadcast or collected, and what is shuffled a word does not grow
with the corpus: blocks keep their size, there are more of them.

Words and bigrams are known by 64-bit hashes.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text
without words (null, empty) has 0 words and a null score; rows of one doc_id
are scored one by one and their sums added; a row without doc_id is known by a
hash of its text; an empty table gives an empty table; further columns do not
matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm import words as W
from clusterlens.sources.tables import table

ALPHA = 0.4
# frequent words and bigrams need no path of their own any more; still set by callers
HOT_WORDS = 1 << 19
HOT_PAIRS = 1 << 17
BUCKET_WORDS = 3_000_000
WORD_BYTES = 6  # a word with the space behind it: the size of a block is known before words are counted
PARTS = 4  # ranges of keys for each block of the corpus
_PIECE = 2 << 20
_U = np.uint64
_RANGES = np.arange(1, 16, dtype=_U) << _U(60)
_ALL_WORDS = _U(0)  # the key whose total is N


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return W.mix(v * _U(0x9E3779B97F4A7C15) ^ W.mix(w, 3), 4)


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ordered, and the sums of their counts, from ordered keys.
    Ranges of keys are merged one by one: this is where a task needs most memory."""
    cuts = [np.concatenate([[0], np.searchsorted(k, _RANGES), [len(k)]]) for k in keys]
    merged, sums = [], []
    for i in range(len(_RANGES) + 1):
        k = np.concatenate([x[c[i]:c[i + 1]] for x, c in zip(keys, cuts, strict=True)])
        if len(k):
            order = np.argsort(k)
            k = k[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            merged.append(k[first])
            c = np.concatenate([x[c[i]:c[i + 1]] for x, c in zip(counts, cuts, strict=True)])
            sums.append(np.add.reduceat(c[order], first, dtype=np.int32))
    return np.concatenate(merged), np.concatenate(sums)


def _pieces(texts: pa.ChunkedArray) -> Iterator[tuple[W.Block, int]]:
    """(piece, number of its first row) of a column of texts."""
    at = 0
    for chunk in texts.chunks:
        for b in W.blocks(chunk, _PIECE):
            yield b, at + b.first
        at += len(chunk)


def _tokens(b: W.Block, hasher: W.SpanHash) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, row, positions of words with one before them in their row,
    hash of the bigram that ends at each of these)."""
    ws, we, rows = W.words(b)
    h = hasher(b.data, ws, we)
    at = 1 + np.flatnonzero(rows[1:] == rows[:-1])
    return h, rows, at, _pair(h[at - 1], h[at])


def _hasher() -> W.SpanHash:
    return W.SpanHash(91, lower=True)


def _counts(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a block's texts, ordered, and how often each occurs."""
    hasher, keys, counts, n = _hasher(), [], [], 0
    for b, _ in _pieces(texts):
        h, _, _, pair = _tokens(b, hasher)
        u, c = np.unique(np.concatenate([h, pair]), return_counts=True)
        keys.append(u), counts.append(c.astype(np.int32))
        n += len(h)
    return _counted([*keys, np.array([_ALL_WORDS])], [*counts, np.array([n], np.int32)])


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _block_counts(dealt: DataFrame, parts: int) -> DataFrame:
    """(block, part, keys, counts): the counts of a block, a row for each range
    of keys."""
    starts = [(i << 64) // parts for i in range(1, parts)]

    def run(docs: pa.Table) -> pa.Table:
        u, c = _counts(docs.column("text"))
        at = np.concatenate([[0], np.searchsorted(u, np.array(starts, _U)), [len(u)]])
        block = docs.column("block")[0].as_py()
        return pa.table({"block": pa.array(np.full(parts, block, np.int32)), "part": pa.array(np.arange(parts, dtype=np.int32)),
                         "keys": _lists(at, u.view(np.int64)), "counts": _lists(at, c)})

    return dealt.groupBy("block").applyInArrow(run, "block int, part int, keys array<long>, counts array<int>")


def _totals(lists: pa.Table) -> pa.Table:
    """(block, part, totals): of a range of keys, the totals of each block's keys."""
    keys, counts = (lists.column(c).combine_chunks() for c in ("keys", "counts"))
    _, at = np.unique(keys.flatten().to_numpy(), return_inverse=True)
    totals = np.bincount(at, weights=counts.flatten().to_numpy()).astype(np.int64)[at]
    ends = np.concatenate([[0], np.cumsum(keys.value_lengths().to_numpy())])
    return pa.table({"block": lists.column("block"), "part": lists.column("part"), "totals": _lists(ends, totals)})


def _score(docs: pa.Table, lists: pa.Table) -> pa.Table:
    """(doc, n, found, log_s) of each text of a block, from the totals of its keys."""
    keys, _ = _counts(docs.column("text"))
    lists = lists.sort_by("part")
    totals = lists.column("totals").combine_chunks().flatten().to_numpy()
    if len(totals) != len(keys):
        raise ValueError(f"a block of texts has changed while it was scored: {len(keys)} keys, {len(totals)} totals")

    def of(some: np.ndarray) -> np.ndarray:
        return totals[np.searchsorted(keys, some)]

    hasher = _hasher()
    log_n = np.log(np.maximum(of(np.array([_ALL_WORDS])), 1))
    n, found, log_s = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64), np.zeros(len(docs))
    for b, first in _pieces(docs.column("text")):
        h, rows, at, pair = _tokens(b, hasher)
        u, i = np.unique(h, return_inverse=True)
        log_c = np.log(of(u))[i]
        s = log_c - log_n
        s[at] += math.log(ALPHA)
        u, i = np.unique(pair, return_inverse=True)
        _, mine, own = np.unique(rows[at] * len(u) + i, return_inverse=True, return_counts=True)
        left = of(u)[i] - own[mine]
        hit = left > 0
        s[at[hit]] = np.log(left[hit]) - log_c[at[hit] - 1]
        here = slice(first, first + len(b))
        n[here] = W.per_row(rows, len(b))
        found[here] = W.per_row(rows[at[hit]], len(b))
        log_s[here] = np.bincount(rows, weights=s, minlength=len(b))
    return pa.table({"doc": docs.column("doc"), "n": pa.array(n), "found": pa.array(found), "log_s": pa.array(log_s)})


def backoff_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(id, n_words, n_found, log_score) of each document; n_found counts the
    words whose bigram another document holds."""
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`"), F.xxhash64(F.col(f"`{text}`"))).cast("bigint").alias("doc"),
                       F.col(f"`{text}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / (WORD_BYTES * bucket_words)))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks)
    # rows are dealt one by one, so copies and rows of one id spread over all blocks
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    dealt = rows.select(block.alias("block"), "doc", "text").repartition(parts, "block")
    lists = _block_counts(dealt, PARTS * blocks).repartition(parts, "part")
    totals = lists.groupBy("part").applyInArrow(_totals, "block int, part int, totals array<long>")
    scored = dealt.groupBy("block").cogroup(totals.repartition(parts, "block").groupBy("block")).applyInArrow(
        _score, "doc long, n long, found long, log_s double")
    out = scored.groupBy("doc").agg(F.sum("n").alias("n_words"), F.sum("found").alias("n_found"), F.sum("log_s").alias("s"))
    return out.select(F.col("doc").alias("id"), "n_words", "n_found", F.when(F.col("n_words") > 0, F.col("s")).alias("log_score"))


def op9_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` under the corpus's bigram model."""
    out = backoff_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_found", F.round("log_score", 6).alias("log_score"))
