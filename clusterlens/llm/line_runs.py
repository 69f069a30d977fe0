"""Operator 5: line dedup over levelled sorted runs of line hashes.

The corpus-wide memory of lines is a set of *runs*: tables of
(h1, h2, n_docs, last_doc, salts) ordered by hash, h1 and h2 being a 128-bit
hash of the line's key (stripped, A-Z lower-cased). Every batch of documents
adds one run; ``fanout`` neighbouring runs of a level are merged into one run
of the next level (hash-ordered merge, summing n_docs and taking the largest
last_doc), so B batches leave O(fanout * log B) runs and each entry is
rewritten O(log B) times. A run's folder name says which batches it covers;
runs covered by a complete larger run do not count, so a compaction that an
executor or driver loss cuts short is simply repeated.

Two ways to use the runs:

* ``dedup_batch``: the streaming form. A batch's lines are merge-anti-joined
  with the runs (a line found there is dropped), then its own lines are added.
* ``line_dedup``: the whole-corpus form. All batches are added, then each
  document's lines are merge-anti-joined with the *repeated* entries: a line
  found in ``min_docs`` documents or more stays in the largest id only.

Hot lines: entries are combined map-side, and the join of lines with entries
is on (hash, salt of the document), see ``shared.py``.

Defined results: a null or empty text is one empty line; a key shorter than
``min_chars`` code points is never dropped; rows of one doc_id are one
document; a null doc_id counts as one document below every id; when all lines
go, the text is empty; an empty table gives an empty table; columns named like
an added one are replaced, all other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterlens.llm import shared
from clusterlens.llm import words as W
from clusterlens.sources.tables import table

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2
NO_ID = -(1 << 63)  # stands for a null doc_id

_KEYS = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
                      T.StructField("doc", T.LongType())])


class LineKeys:
    """Line spans of a block and their 128-bit keys."""

    def __init__(self, min_chars: int):
        self.min_chars = min_chars
        self.one, self.two = W.SpanHash(51, lower=True), W.SpanHash(52, lower=True)

    def __call__(self, b: W.Block):
        """(line start, line end, row, index of lines with a key, h1, h2)."""
        ls, le, lr = W.lines(b)
        ws, we, _ = W.words(b)
        i0, i1 = np.searchsorted(ws, ls), np.searchsorted(ws, le)
        at = np.flatnonzero(i0 < i1)
        ks, ke = ws[i0[at]], we[i1[at] - 1]
        points = np.zeros(len(b.data) + 1, np.int64)
        np.cumsum((b.data & 0xC0) != 0x80, out=points[1:])
        long = points[ke] - points[ks] >= self.min_chars
        at, ks, ke = at[long], ks[long], ke[long]
        return ls, le, lr, at, self.one(b.data, ks, ke), self.two(b.data, ks, ke)


def line_keys(docs: DataFrame, doc: Column, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc): the distinct line keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = LineKeys(min_chars)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for b in W.blocks(batch.column(1)):
                _, _, lr, at, h1, h2 = keys(b)
                row = lr[at]
                order = np.lexsort((h2, h1, row))
                h1, h2, row = h1[order], h2[order], row[order]
                new = np.ones(len(row), bool)
                new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[new].view(np.int64)), pa.array(h2[new].view(np.int64)),
                     pa.array(ids[b.first + row[new]])], schema=_arrow(_KEYS))

    return docs.select(F.coalesce(doc, F.lit(NO_ID)).cast("bigint").alias("doc"), F.col(text)).mapInArrow(run, _KEYS)


def _arrow(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, pa.int64()) for f in schema.fields])


class LineRuns:
    """The runs of one corpus in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.fanout = spark, fanout
        self.folder = folder or shared.new_folder(spark, "line-runs")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm, p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> list[tuple[int, int]]:
        """(first, last) batch of every live run, in batch order."""
        jvm, p, fs = self._fs()
        if not fs.exists(p):
            return []
        found = [re.fullmatch(r"run-(\d+)-(\d+)", s.getPath().getName()) for s in fs.listStatus(p)]
        done = sorted((int(m[1]), int(m[2])) for m in found
                      if m and fs.exists(jvm.org.apache.hadoop.fs.Path(self.folder, m[0] + "/_SUCCESS")))
        return [r for r in done if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in done)]

    def _path(self, run: tuple[int, int]) -> str:
        return f"{self.folder}/run-{run[0]:06d}-{run[1]:06d}"

    def _read(self, runs: list[tuple[int, int]]) -> DataFrame:
        schema = "h1 long, h2 long, n_docs long, last_doc long, salts long"
        if not runs:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(self._path(r)) for r in runs]
        return reduce(DataFrame.union, parts)

    def _write(self, entries: DataFrame, run: tuple[int, int]) -> None:
        entries.sortWithinPartitions("h1", "h2").write.mode("overwrite").parquet(self._path(run))

    @staticmethod
    def _merged(entries: DataFrame) -> DataFrame:
        return entries.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"),
                                               F.bit_or("salts").alias("salts"))

    def add(self, keys: DataFrame) -> None:
        """Add a batch of line keys (h1, h2, doc); no document may come in two
        batches. Then compact levels that are full."""
        live = self.runs()
        at = live[-1][1] + 1 if live else 0
        own = keys.distinct().withColumn("salt", shared.salt(F.col("doc")))
        own = own.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc"),
                                          shared.salt_mask().alias("salts"))
        self._write(own, (at, at))
        self._compact()

    def _compact(self) -> None:
        while True:
            live = self.runs()
            tail = live[-self.fanout:]
            sizes = {b - a for a, b in tail}
            if len(tail) < self.fanout or len(sizes) > 1:
                return
            self._write(self._merged(self._read(tail)), (tail[0][0], tail[-1][1]))
            jvm, _, fs = self._fs()
            for r in tail:
                fs.delete(jvm.org.apache.hadoop.fs.Path(self._path(r)), True)

    def entries(self) -> DataFrame:
        """All entries, merged over the live runs."""
        live = self.runs()
        return self._read(live) if len(live) == 1 else self._merged(self._read(live))

    def repeated(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(h1, h2, salt, last_doc) of the entries of ``min_docs`` documents or
        more, one row per salt."""
        found = self.entries().where(F.col("n_docs") >= min_docs).drop("n_docs")
        return shared.by_salt(found)

    def seen(self) -> DataFrame:
        """(h1, h2) of every entry."""
        return self.entries().select("h1", "h2")


def _drop_lines(docs: DataFrame, drops: DataFrame, doc: Column, text: str, min_chars: int) -> DataFrame:
    """``docs`` without the lines listed in ``drops`` (doc, gone: array of
    (h1, h2)), plus n_lines and n_dropped."""
    docs = shared.without(docs, "n_lines", "n_dropped")
    own = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own if c != text]).alias("row") if len(own) > 1
                       else F.struct(F.lit(0).alias("_")).alias("row"),
                       F.col(f"`{text}`").alias("text"), F.coalesce(doc, F.lit(NO_ID)).cast("bigint").alias("doc"))
    rows = rows.join(drops, "doc", "left").drop("doc")
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()),
                           T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = LineKeys(min_chars)
        for batch in batches:
            gone = batch.column(2)
            for b in W.blocks(batch.column(1)):
                part = gone.slice(b.first, len(b))
                texts = batch.column(1).slice(b.first, len(b)).to_pylist()
                texts = [t or "" for t in texts]
                n_lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
                n_dropped = np.zeros(len(b), np.int64)
                if part.null_count < len(part):
                    _cut(keys, b, part, texts, n_dropped)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.first, len(b)), pa.array(texts, pa.string()), pa.array(n_lines),
                     pa.array(n_dropped)], names=["row", "text", "n_lines", "n_dropped"])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in own],
                      "n_lines", "n_dropped")


def _cut(keys: LineKeys, b: W.Block, gone: pa.Array, texts: list[str], n_dropped: np.ndarray) -> None:
    ls, le, lr, at, h1, h2 = keys(b)
    flat = gone.flatten()
    listed = np.repeat(np.arange(len(gone)), gone.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    one = W.mix(flat.field(0).to_numpy(zero_copy_only=False).view(np.uint64), 1)
    two = flat.field(1).to_numpy(zero_copy_only=False).view(np.uint64)
    row = lr[at]
    mark = lambda a, z, r: W.mix(a ^ z ^ W.mix(r.astype(np.uint64), 3), 4)
    hit = np.isin(mark(W.mix(h1, 1), h2, row), mark(one, two, listed))
    dead = np.zeros(len(ls), bool)
    dead[at[hit]] = True
    of = W.bounds(lr, len(b))
    for r in np.unique(row[hit]):
        mine = slice(of[r], of[r + 1])
        keep = ~dead[mine]
        n_dropped[r] = len(keep) - int(keep.sum())
        texts[r] = b"\n".join([b.data[s:e].tobytes() for s, e in zip(ls[mine][keep], le[mine][keep], strict=True)]).decode()


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
               min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with the lines removed that ``min_docs`` documents or more hold,
    except in the largest doc_id; adds n_lines (before) and n_dropped."""
    spark = docs.sparkSession
    doc = F.col(f"`{doc_id}`")
    keys = line_keys(docs, doc, text, min_chars).withColumn(
        "batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int"))
    folder = shared.new_folder(spark, "line-keys")
    keys.write.partitionBy("batch").parquet(folder)
    staged = spark.read.schema("h1 long, h2 long, doc long, batch int").parquet(folder)
    runs = LineRuns(spark, fanout=fanout)
    for k in range(batches):
        runs.add(staged.where(F.col("batch") == k).select("h1", "h2", "doc"))
    lines = staged.select("h1", "h2", "doc", shared.salt(F.col("doc")).alias("salt"))
    gone = lines.join(runs.repeated(min_docs), ["h1", "h2", "salt"]).where(F.col("doc") != F.col("last_doc"))
    drops = gone.groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    return _drop_lines(docs, drops, doc, text, min_chars)


def dedup_batch(docs: DataFrame, runs: LineRuns, doc_id: str = "doc_id", text: str = "text",
                min_chars: int = MIN_CHARS) -> DataFrame:
    """The streaming form: ``docs`` without the lines that earlier batches hold;
    the batch's own lines are added to ``runs`` before this returns. The
    result is a written table, so that reading it again gives the same rows."""
    doc = F.col(f"`{doc_id}`")
    keys = shared.written(line_keys(docs, doc, text, min_chars), "batch-keys")
    known = keys.join(runs.seen(), ["h1", "h2"], "left_semi")
    drops = known.groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    out = shared.written(_drop_lines(docs, drops, doc, text, min_chars), "batch-lines")
    runs.add(keys)
    return out


def op5_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (SELECT doc_id, i, line,
        translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS i
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))),
g AS (SELECT k, max(doc_id) AS last_doc FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.doc_id, i, line, (g.k IS NOT NULL AND l.doc_id <> g.last_doc) AS gone FROM l LEFT JOIN g ON l.k = g.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
