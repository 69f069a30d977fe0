"""Operator 13: removal of long byte strings that a corpus holds more than once,
by threshold-bounded interval expansion on Burrows-Wheeler transforms.

Every window of ``least`` bytes that also starts elsewhere is repeated; each byte
that a repeated window covers goes. A transform of the whole corpus would need
one global order of all its suffixes; the windows are dealt into transforms of
bounded size instead, so that equal windows always meet:

1. ``anchors``: a window's *anchor* is the ``gram`` bytes in it whose hash is least
   (the leftmost of equals). It depends on the window's bytes alone, so equal
   windows have equal anchors. Neighbouring windows mostly share one; a run of
   them is a *stretch*: its anchor's hash, a hash of its bytes, and its place.
2. Equal stretches become one, with a count and one place (combined map-side,
   so a passage in a third of all documents is one row per task). Stretches
   whose anchor occurs once hold nothing repeated and go.
3. The bytes of the others are read from their documents (neighbours with one
   content each as one string), and tasks build transforms of whole anchors, a block of at most ``BLOCK_BYTES`` at a time
   (``bwt.py``): backward extension, breadth first, up to ``least`` bytes. Rows left open
   form groups of equal windows; a group counts its stretches' copies.
4. An anchor with more than ``CONTEXTS`` different stretches would fill a
   block: its stretches are dealt again, as texts of their own, by longer anchors, in the
   end by whole windows, whose stretches have one content each. This is
   exact; the bound sets only how the work is dealt.
5. The repeated runs go back to all places of their stretch (a join that Spark
   splits where one stretch holds many places), are gathered by document
   and cut from its bytes.

Documents lie in a table bucketed by row number, which serves steps 3 and 5
without a further shuffle of the texts.

Defined results: a null text is empty; texts shorter than ``least`` keep all bytes;
rows that repeat are separate texts (each is the other's copy); a null id
stays; an empty table gives no rows; other columns pass through, those named
like an added one are replaced. What is kept of a text may cut a UTF-8 character,
so it is binary.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterlens.llm import bwt, shared
from clusterlens.llm import words as W
from clusterlens.sources.tables import table

LEAST = 200
GRAMS = (64, 128)  # anchor lengths, before whole windows
CONTEXTS = 1024
BLOCK_BYTES = 1 << 19
TASK_BYTES = 8 << 20
JOINED = 1 << 15  # windows of a string of several stretches
_PIECE = 1 << 20  # windows of a text treated at a time
_PLACE = (1 << 22) - 1


class Anchors:
    """The stretches of a block of texts."""

    def __init__(self, least: int, gram: int):
        if not 1 <= gram <= least:
            raise ValueError("an anchor is 1 .. least bytes long")
        self.least, self.gram = least, gram
        self.name, self.content = W.SpanHash(71), W.SpanHash(73)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, first window, windows, anchor's hash, hash of the bytes) of every stretch."""
        lengths = ends - starts
        long = np.flatnonzero(lengths >= self.least)
        small = long[lengths[long] <= _PIECE]
        if len(small):
            yield from self._pieces(data, starts[small], ends[small], small, np.zeros(len(small), np.int64))
        for t in long[lengths[long] > _PIECE]:
            for at in range(int(starts[t]), int(ends[t]) - self.least + 1, _PIECE):
                to = min(at + _PIECE + self.least - 1, int(ends[t]))
                yield from self._pieces(data, np.array([at]), np.array([to]), np.array([t]), np.array([at - starts[t]]))

    def _pieces(self, data, starts, ends, text, offset):
        lo = 0
        while lo < len(starts):  # runs of texts that lie within a piece
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + 2 * _PIECE, "right")))
            base = int(starts[lo])
            yield self._stretches(data[base:int(ends[hi - 1])], starts[lo:hi] - base, ends[lo:hi] - base,
                                  text[lo:hi], offset[lo:hi])
            lo = hi

    def _stretches(self, data, starts, ends, text, offset):
        at = np.arange(len(data) - self.gram + 1)
        name = self.name(data, at, at + self.gram)
        best = (name & ~np.uint64(_PLACE)) | at.astype(np.uint64)
        span, have = self.least - self.gram + 1, 1
        while have < span:  # least of the next ``have`` places, doubled up to ``span``
            step = min(have, span - have)
            best = np.minimum(best[:-step], best[step:])
            have += step
        place = (best & np.uint64(_PLACE)).astype(np.int64)
        sizes = ends - starts - self.least + 1
        of = np.repeat(np.arange(len(starts)), sizes)
        window = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[of]
        place = place[window]
        new = np.ones(len(of), bool)
        new[1:] = (place[1:] != place[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(of)))
        w, p, of = window[first], place[first], of[first]
        return (text[of], w - starts[of] + offset[of], count.astype(np.int32),
                name[p], self.content(data, w, w + count + self.least - 1))


_STRETCH = T.StructType([T.StructField("row", T.LongType()), T.StructField("at", T.LongType()),
                         T.StructField("size", T.IntegerType()), T.StructField("h", T.LongType()),
                         T.StructField("g", T.LongType()), T.StructField("n", T.IntegerType())])


def stretches(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """(row, at, size, h, g, n) of the stretches of ``texts`` (row, data, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Anchors(least, gram)
        for batch in batches:
            rows, times = batch.column(0), batch.column(2).to_numpy()
            for b in W.blocks(batch.column(1).cast(pa.large_binary()).view(pa.large_string())):
                for text, at, size, h, g in found(b.data, b.starts, b.ends):
                    own = b.first + text
                    yield pa.RecordBatch.from_arrays(
                        [rows.take(pa.array(own)), pa.array(at), pa.array(size), pa.array(h.view(np.int64)),
                         pa.array(g.view(np.int64)), pa.array(times[own])], names=_STRETCH.names)

    return texts.select("row", "data", "n").mapInArrow(run, _STRETCH)


def candidates(found: DataFrame) -> DataFrame:
    """(h, g, n, row, at, size, contexts) of the different stretches whose anchor
    occurs twice or more: their copies and one place of each."""
    one = found.groupBy("h", "g").agg(
        F.sum("n").alias("n"), F.min("row").alias("row"), F.min_by("at", "row").alias("at"), F.min("size").alias("size"))
    one = shared.written(one, "stretches")
    anchors = one.groupBy("h").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("contexts")).where("all > 1")
    return one.join(anchors.drop("all"), "h")


_MEMBER = T.StructType([T.StructField("h", T.LongType()), T.StructField("g", T.LongType()),
                        T.StructField("at", T.LongType()), T.StructField("size", T.IntegerType())])
_STRINGS = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("n", T.IntegerType()),
                         T.StructField("h", T.LongType()), T.StructField("contexts", T.LongType()),
                         T.StructField("members", T.ArrayType(_MEMBER))])


def _with_bytes(picked: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """``picked`` (h, g, n, row, at, size, contexts) as strings (row, data, n, h,
    contexts, members: the stretches of the string). Neighbouring stretches whose anchors
    have one content each become one string, so that their common bytes are
    held once; no other string has windows with these anchors."""
    held = picked.groupBy("row").agg(F.collect_list(F.struct("at", "size", "h", "g", "n", "contexts")).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, held in zip(batch.column(0), batch.column(1), strict=True):
                whole, list_ = data.as_py(), held.values
                at, size, h, g, n, contexts = (list_.field(k).to_numpy() for k in range(6))
                order = np.argsort(at)
                at, size, h, g, n, contexts = (x[order] for x in (at, size, h, g, n, contexts))
                follows = (contexts[1:] == 1) & (contexts[:-1] == 1) & (at[1:] == at[:-1] + size[:-1])
                follows &= at[1:] // JOINED == at[:-1] // JOINED
                first = np.flatnonzero(np.concatenate([[True], ~follows]))
                last = np.append(first[1:], len(at)) - 1
                to = at[last] + size[last] + least - 1
                cut = [whole[a:b] for a, b in zip(at[first].tolist(), to.tolist(), strict=True)]
                inside = at - np.repeat(at[first], last - first + 1)
                members = pa.StructArray.from_arrays([pa.array(h), pa.array(g), pa.array(inside), pa.array(size)],
                                                     names=_MEMBER.names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cut, pa.binary()), pa.array(np.minimum(n[first], 2).astype(np.int32)), pa.array(h[first]),
                     pa.array(contexts[first]),
                     pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), members)],
                    names=_STRINGS.names)

    out = texts.select("row", "data").join(held, "row").select("data", "held").mapInArrow(run, _STRINGS)
    return shared.written(out.withColumn("row", F.monotonically_increasing_id()), "strings")


_RUNS = "row long, runs array<struct<a:long,b:long>>"


def _runs(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """One line per row of runs (a, b) that lie in row order."""
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)),
                                     pa.StructArray.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]))
    return pa.RecordBatch.from_arrays([pa.array(row[first]), lists], names=["row", "runs"])


def _by_transform(texts: DataFrame, least: int) -> DataFrame:
    """(row, runs) of repeated windows, first to last, by transforms of whole anchors."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    tasks = max(size // TASK_BYTES + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def transform(held: list) -> pa.RecordBatch:
        row, times, data = (np.concatenate([x[k] for x in held]) for k in (0, 1, 2))
        lengths = np.concatenate([x[3] for x in held])
        ends = np.cumsum(lengths)
        string, at = bwt.repeated_windows(data, ends - lengths, ends, times, least)
        new = np.ones(len(at), bool)
        new[1:] = (string[1:] != string[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1 if len(first) else first
        return _runs(row[string[first]], at[first], at[last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            cut = np.flatnonzero(h[1:] != h[:-1]) + 1
            for lo, hi in zip(np.append(0, cut), np.append(cut, len(h)), strict=True):
                if size >= BLOCK_BYTES and h[lo] != last:
                    yield transform(held)
                    held, size = [], 0
                part = batch.slice(lo, hi - lo)
                data = part.column(3).cast(pa.large_binary())
                offs = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1]
                raw = np.frombuffer(data.buffers()[2], np.uint8)[offs[0]:offs[-1]]
                held.append((part.column(1).to_numpy(), part.column(2).to_numpy(), raw, np.diff(offs)))
                size, last = size + len(raw), h[lo]
        if held:
            yield transform(held)

    dealt = texts.select("h", "row", "n", "data").repartition(tasks, "h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, _RUNS)


def repeated_runs(texts: DataFrame, least: int = LEAST, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """(row, a, b): runs of starts a .. b of repeated windows in ``texts`` (row,
    data, n: copies), which should be a written table."""
    gram = grams[0] if grams and grams[0] < least else least
    found = shared.written(stretches(texts, least, gram), "anchors")
    held = _with_bytes(candidates(found), texts, least)
    crowded = held.where(F.col("contexts") > CONTEXTS)
    runs = _by_transform(held.where(F.col("contexts") <= CONTEXTS), least).select("row", F.inline("runs"))
    if gram < least and not crowded.isEmpty():
        runs = runs.union(repeated_runs(crowded, least, grams[1:]))
    parts = held.select("row", F.inline("members")).join(runs, "row").select(
        "h", "g", (F.greatest("a", "at") - F.col("at")).alias("a"),
        (F.least("b", F.col("at") + F.col("size") - 1) - F.col("at")).alias("b")).where("a <= b")
    by_stretch = parts.groupBy("h", "g").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    by_stretch = shared.written(by_stretch, "repeated")
    places = found.select("row", "at", "h", "g").join(by_stretch, ["h", "g"])
    return places.select("row", "at", F.inline("runs")).select("row", (F.col("at") + F.col("a")).alias("a"),
                                                               (F.col("at") + F.col("b")).alias("b"))


class _Texts:
    """Rows and their bytes in a table bucketed by row number."""

    def __init__(self, docs: DataFrame, text: str):
        self.spark = docs.sparkSession
        self.name, self.path = f"suffix_texts_{uuid.uuid4().hex}", shared.new_folder(self.spark, "texts")
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        data = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
        own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(None).cast("int").alias("_")])
        rows = docs.select(F.monotonically_increasing_id().alias("row"), data.alias("data"), F.lit(1).alias("n"), own.alias("own"))
        (rows.repartition(buckets, "row").write.option("path", self.path).bucketBy(buckets, "row")
         .format("parquet").saveAsTable(self.name))
        self.rows = self.spark.table(self.name)


def drop_repeated(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with ``kept`` (binary: the text's bytes without repeated ones) in
    place of the text, ``spans`` (removed runs: from, to), n_bytes, n_removed and n_spans."""
    docs = shared.without(docs, "kept", "spans", "n_bytes", "n_removed", "n_spans")
    texts = _Texts(docs, text).rows
    runs = repeated_runs(texts.select("row", "data", "n"), least)
    runs = runs.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    rows = texts.select("row", "own", "data").join(runs, "row", "left").select("own", "data", "runs")
    span = T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])
    schema = T.StructType([rows.schema["own"], T.StructField("kept", T.BinaryType()), T.StructField("spans", T.ArrayType(span)),
                           T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans, n_bytes, n_removed = [], [], [], []
            for data, runs in zip(batch.column(1), batch.column(2), strict=True):
                whole = data.as_buffer().to_pybytes()
                gone = _merged(runs.values, least) if runs.is_valid else []
                ends = [0, *[e for _, e in gone]]
                kept.append(b"".join([whole[e:s] for e, s in zip(ends, [*[s for s, _ in gone], len(whole)], strict=True)]))
                spans.append([{"from": s, "to": e} for s, e in gone])
                n_bytes.append(len(whole))
                n_removed.append(len(whole) - len(kept[-1]))
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), pa.array(spans, kind), pa.array(n_bytes, pa.int64()),
                 pa.array(n_removed, pa.int64())], names=schema.names)

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"own.`{c}`") for c in docs.columns if c != text], "kept", "spans", "n_bytes", "n_removed",
                      F.size("spans").cast("bigint").alias("n_spans"))


def _merged(runs: pa.StructArray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows starting in ``runs`` cover."""
    a, b = runs.field(0).to_numpy(), runs.field(1).to_numpy() + least
    order = np.argsort(a)
    a, b = a[order], np.maximum.accumulate(b[order])
    first = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return list(zip(a[first].tolist(), b[np.append(first[1:], len(a)) - 1].tolist(), strict=True))


def op13_suffix_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of ``documents`` without strings of 200 bytes found elsewhere."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans",
                                      F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, i, md5(substr(x, 2 * i + 1, {2 * LEAST})) AS m
  FROM (SELECT r, x, unnest(range(length(x) // 2 - {LEAST - 1})) AS i FROM t)),
hit AS (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY m) > 1),
isle AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM (
  SELECT r, i, (coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i), {LEAST + 1}) > {LEAST})::INT AS fresh FROM hit)),
span AS (SELECT r, k, min(i) AS s, max(i) + {LEAST} AS e FROM isle GROUP BY r, k),
keep AS (SELECT r, s, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY s) AS was FROM span),
cut AS (SELECT t.r, count(s) AS n_spans, coalesce(sum(e - s), 0) AS n_removed,
    coalesce(string_agg(substr(x, 2 * was + 1, 2 * (s - was)), '' ORDER BY s), '')
      || substr(any_value(x), 2 * coalesce(max(e), 0) + 1) AS kept
  FROM t LEFT JOIN keep k ON t.r = k.r GROUP BY t.r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans,
  sha256(unhex(kept)) AS kept_sha256
FROM t JOIN cut USING (r)
"""
