"""Operator 3: benchmark decontamination by template canonicalisation.

A text becomes a sequence of template tokens: a number becomes ``<num>``, a
unit right after a number ``<unit>``, a run of capitalised words (not
all in capitals) inside a sentence ``<name>``; any other word is a literal (outer punctuation stripped,
case folded; words of punctuation only do not count). Windows of WINDOW template
tokens are hash-joined between documents and benchmark items, so a question
whose numbers, names or units were changed still matches. Then the slots are
checked along each alignment (document position minus item position): every
value of the item must go with one value of the document wherever it occurs;
windows that hold a value which goes with several count only when all their
slots hold the item's own values, the other windows of the alignment stay.
A document is contaminated by an item when the windows that count cover
MIN_COVER tokens of the item, all of it if it is shorter, or half of it (at
least one window). Beside them, windows of plain words (all words, case folded, no
slots, whatever a word would stand for) are joined for every item, so that a
verbatim copy matches however few literals an item has, in any case and at any
place; a pair found by both ways shows the figures of the template windows, a
pair found by words alone counts words.

Scale: documents are scanned once in NumPy blocks; only windows that pass a
Bloom filter of the benchmark's windows leave the task. The filter has a fixed
size (FILTER_BITS, whatever the benchmark's size), is combined by a
distributed aggregation and broadcast; false positives end in the exact hash
join, which is salted by document (a passage may lie in a third of all
documents). Groups are (document, item, alignment), bounded by the item.

Defined results: null and empty texts match nothing; an item of fewer than
MIN_ITEM template tokens or without MIN_LITERALS literals cannot be told from chance with other slot values
and is matched by its words only, one of fewer than MIN_ITEM words only by a document of just these words;
an item shorter than a window is one window of its own length; a row without
doc_id is known by a hash of its text; repeated rows of one doc_id count as
one document; empty tables give an empty result; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm import shared
from clusterlens.llm import words as W
from clusterlens.sources.tables import table

WINDOW = 8
MIN_ITEM = 5
MIN_LITERALS = 4
MIN_COVER = 13
# (of plain words or not, size) of all windows
SIZES = [(False, n) for n in range(MIN_ITEM, WINDOW + 1)] + [(True, n) for n in range(1, WINDOW + 1)]
FILTER_BITS = 1 << 24
_U = np.uint64

# Number words and units that are slots.
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
                "sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred "
                "thousand million billion").split()
UNITS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces "
         "pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours "
         "day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees "
         "mph kmh watt watts volt volts meter meters metre metres kilometer kilometers kilometre kilometres").split()
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?:")] = True
_INK = np.zeros(256, bool)  # bytes of letters and digits
_INK[48:58] = _INK[65:91] = _INK[97:123] = _INK[128:] = True
NUM, NAME, UNIT = 1, 2, 3


def fold(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(case-folded bytes, whether a byte begins an upper-case letter), for
    A-Z and the upper-case letters U+00C0 .. U+00DE."""
    upper = (data >= 65) & (data <= 90)
    out = W.LOWER[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    second = after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    out[second] += 0x20
    upper[:-1] |= second[1:]
    return out, upper


class Templates:
    """Template tokens of a block: row, canonical hash, value hash and kind
    (0 literal, else NUM, NAME or UNIT) of each."""

    def __init__(self):
        self.hash = W.SpanHash(31)
        self.numbers, self.units = self._known(NUMBER_WORDS), self._known(UNITS)

    def _known(self, words: list[str]) -> np.ndarray:
        column = pa.array(words)
        return np.concatenate([self.hash(b.data, b.starts, b.ends) for b in W.blocks(column)])

    def __call__(self, b: W.Block):
        ws, we, rows = W.words(b)
        ink = np.flatnonzero(_INK[b.data])
        i0, i1 = np.searchsorted(ink, ws), np.searchsorted(ink, we)
        real = i0 < i1
        breaks = np.zeros(len(b.data) + 1, np.int64)
        np.cumsum(b.data == 10, out=breaks[1:])
        start = np.ones(len(ws), bool)  # first word of a sentence
        if len(ws) > 1:
            start[1:] = ((rows[1:] != rows[:-1]) | _STOPS[b.data[we[:-1] - 1]] | (breaks[ws[1:]] > breaks[we[:-1]]))
        # a dropped word hands its sentence start on to the next word
        carry = np.flatnonzero(start & ~real)
        for at in carry:
            if at + 1 < len(start):
                start[at + 1] = True
        start, rows = start[real], rows[real]
        s, e = ink[i0[real]], ink[i1[real] - 1] + 1
        data, upper = fold(b.data)
        second = np.minimum(s + 1 + (data[s] == 0xC3), e - 1)  # "Anna", not "I" or "NASA"
        name = upper[s] & ~start & (second > s + (data[s] == 0xC3)) & ~upper[second]
        joins = np.zeros(len(s), bool)  # goes on with the name before it
        joins[1:] = name[1:] & name[:-1] & (rows[1:] == rows[:-1])
        head = np.flatnonzero(~joins)
        last = np.append(head[1:], len(s)) - 1 if len(head) else head
        s, e, rows, name = s[head], e[last], rows[head], name[head]
        value = self.hash(data, s, e)
        kind = np.zeros(len(s), np.int64)
        kind[name] = NAME
        digit = (data[s] >= 48) & (data[s] <= 57) if len(s) else np.zeros(0, bool)
        kind[digit | (np.isin(value, self.numbers) & ~name)] = NUM
        after = np.zeros(len(s), bool)
        after[1:] = (kind[:-1] == NUM) & (rows[1:] == rows[:-1])
        kind[after & np.isin(value, self.units)] = UNIT
        canon = np.where(kind > 0, W.mix(kind.astype(_U), 33), value)
        return rows, canon, value, kind

    def plain(self, b: W.Block):
        """Row and case-folded hash of every word, whatever it stands for."""
        ws, we, rows = W.words(b)
        ink = np.flatnonzero(_INK[b.data])
        i0, i1 = np.searchsorted(ink, ws), np.searchsorted(ink, we)
        real = i0 < i1
        return rows[real], self.hash(fold(b.data)[0], ink[i0[real]], ink[i1[real] - 1] + 1)

    def windows(self, rows: np.ndarray, canon: np.ndarray, kind: np.ndarray, size: int):
        """(hash, first position) of the windows with enough literals."""
        h, at = W.windows(canon, rows, size)
        literal = np.concatenate([[0], np.cumsum(kind == 0)])
        enough = literal[at + size] - literal[at] >= MIN_LITERALS
        return W.mix(h[enough], size), at[enough]


def _positions(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(W.mix(h, 41 + j) % _U(bits)).astype(np.int64) for j in range(2)]


_WINDOW_ROW = "id long, pos int, size int, lit boolean, h long, vals array<long>, n_tokens int"


def _window_rows(texts: DataFrame, sizes: list[tuple[bool, int]], item: bool, bits: int = 0, filter_=None) -> DataFrame:
    """Windows of ``texts`` (id, text). Items: windows of WINDOW tokens, or one of the
    item's own length; documents: windows of the ``sizes`` (of plain words or not,
    size) that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        known = np.frombuffer(filter_.value, np.uint64) if filter_ is not None else None
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for b in W.blocks(batch.column(1)):
                word_rows, words = templates.plain(b)
                tokens = {False: templates(b), True: (word_rows, words, words, np.zeros(len(words), np.int64))}
                counts = {lit: W.per_row(t[0], len(b)) for lit, t in tokens.items()}
                firsts = {lit: W.bounds(t[0], len(b)) for lit, t in tokens.items()}
                for lit, size in sizes:
                    (rows, canon, value, kind), count, of = tokens[lit], counts[lit], firsts[lit]
                    if lit:
                        h, at = W.windows(canon, rows, size)
                        h = W.mix(h, 64 + size)
                        if size < MIN_ITEM:  # such an item must be all of the document
                            h, at = h[count[rows[at]] == size], at[count[rows[at]] == size]
                    else:
                        h, at = templates.windows(rows, canon, kind, size)
                    r = rows[at]
                    if item:
                        ok = (count[r] >= WINDOW) if size == WINDOW else (count[r] == size)
                    else:
                        ok = np.ones(len(h), bool)
                        for p in _positions(h, bits):
                            ok &= (known[p >> 6] >> (p & 63).astype(_U)) & _U(1) != 0
                    h, at, r = h[ok], at[ok], r[ok]
                    if not len(h):
                        continue
                    slots = kind[at[:, None] + np.arange(size)] > 0
                    vals = value[at[:, None] + np.arange(size)][slots]
                    offsets = np.concatenate([[0], np.cumsum(slots.sum(axis=1))]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[b.first + r]), pa.array((at - of[r]).astype(np.int32)),
                         pa.array(np.full(len(h), size, np.int32)), pa.array(np.full(len(h), lit)),
                         pa.array(h.view(np.int64)),
                         pa.ListArray.from_arrays(pa.array(offsets), pa.array(vals.view(np.int64))),
                         pa.array(count[r].astype(np.int32))],
                        names=["id", "pos", "size", "lit", "h", "vals", "n_tokens"])

    return texts.select("id", "text").mapInArrow(run, _WINDOW_ROW)


def row_id(doc_id: str, text: str) -> Column:
    return F.coalesce(F.col(f"`{doc_id}`"), F.xxhash64(F.col(f"`{text}`"))).cast("bigint")


def _filter_of(items: DataFrame, bits: int) -> bytes:
    """Bloom filter of the items' window hashes: at most bits / 64 words reach
    the driver, however many items there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            p = np.concatenate(_positions(h, bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array((p >> 6).astype(np.int32)), pa.array((_U(1) << (p & 63).astype(_U)).view(np.int64))],
                names=["w", "bit"])

    words = items.select("h").mapInArrow(run, "w int, bit long").groupBy("w").agg(F.bit_or("bit").alias("bit"))
    out = np.zeros(bits // 64, np.uint64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("bit").to_numpy().view(np.uint64)
    return out.tobytes()


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", bits: int = FILTER_BITS) -> DataFrame:
    """(id, item_id, n_tokens, n_covered, exact) of each document and the items
    that contaminate it; exact: all slots hold the item's own values."""
    spark = docs.sparkSession
    bench = items.select(F.col(f"`{item_id}`").cast("bigint").alias("id"), F.col(f"`{item_text}`").alias("text"))
    bench = shared.written(_window_rows(bench, SIZES, item=True), "item-windows")
    known = spark.sparkContext.broadcast(_filter_of(bench, bits))
    used = sorted((r["lit"], r["size"]) for r in bench.select("lit", "size").distinct().collect())  # at most len(SIZES) rows
    rows = docs.select(row_id(doc_id, text).alias("id"), F.col(f"`{text}`").alias("text"))
    found = shared.written(_window_rows(rows, used, False, bits, known), "doc-windows")
    side = bench.select("h", "size", "lit", F.col("id").alias("item_id"), F.col("pos").alias("ipos"),
                        F.col("vals").alias("ivals"), F.col("n_tokens").alias("n_item"))
    hit = shared.lookup(found.select("id", "pos", "h", "vals"), "h", side, "id", "inner")
    # slot values of one window have one template, so they pair up in order
    hit = hit.select("id", "item_id", "n_item", "lit", (F.col("pos") - F.col("ipos")).alias("shift"), "ipos", "size",
                     F.arrays_zip(F.col("ivals").alias("i"), F.col("vals").alias("d")).alias("slots"))
    line = hit.groupBy("id", "item_id", "n_item", "lit", "shift").agg(
        F.collect_set(F.struct("ipos", "size", "slots")).alias("at"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    # item values that go with several document values on this alignment
    line = line.withColumn("names", F.array_sort(F.transform("slots", lambda s: s["i"])))
    line = line.withColumn("torn", F.array_distinct(F.filter(
        "names", lambda v, i: (i > 0) & (v == F.get("names", i - 1)))))
    sound = F.filter("at", lambda w: F.forall(w["slots"], lambda s: ~F.array_contains("torn", s["i"]))
                     | F.forall(w["slots"], lambda s: s["i"] == s["d"]))
    line = line.withColumn("at", F.when(F.size("torn") == 0, F.col("at")).otherwise(sound))
    line = line.withColumn("exact", F.forall("slots", lambda s: s["i"] == s["d"]))
    covered = F.flatten(F.transform("at", lambda w: F.sequence(w["ipos"], w["ipos"] + w["size"] - 1)))
    line = line.select("id", "item_id", "n_item", "lit", "exact", F.explode(F.array_distinct(covered)).alias("p"))
    # one row per covered token of an item: bounded by the item's length
    both = line.groupBy("id", "item_id", "n_item", "lit", "p").agg(F.max("exact").alias("exact"))
    out = both.groupBy("id", "item_id", "lit", F.col("n_item").alias("n_tokens")).agg(
        F.count(F.lit(1)).cast("int").alias("n_covered"), F.min("exact").alias("exact"))
    enough = (F.col("n_covered") >= F.least(F.lit(MIN_COVER), F.col("n_tokens"))) | \
             ((F.col("n_covered") >= WINDOW) & (2 * F.col("n_covered") >= F.col("n_tokens")))
    best = F.min_by(F.struct("n_tokens", "n_covered", "exact"), "lit")
    return out.where(enough).groupBy("id", "item_id").agg(best.alias("b")).select("id", "item_id", "b.*")


def literal_only(items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id) of the items that have windows of plain words only, no template window."""
    bench = items.select(F.col(f"`{item_id}`").cast("bigint").alias("id"), F.col(f"`{item_text}`").alias("text"))
    return _window_rows(bench, SIZES, item=True).groupBy("id").agg(F.min("lit").alias("lit")).where("lit").select("id")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones."""
    return shared.without_ids(docs, row_id(doc_id, text), contaminated(docs, items, doc_id, text))


def op3_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated ``documents`` with the ``benchmark`` items they leak."""
    out = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"),
                       table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "item_id", "n_tokens", "n_covered", "exact")
