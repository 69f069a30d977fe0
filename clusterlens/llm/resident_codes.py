"""Operator 12: product quantisation of vectors by member-resident Lloyd rounds.

A vector is cut into equal consecutive parts; each part position has a codebook.
The parts live in one *bucketed* table, dealt by (position, entry, salt): a
bucket owns the members of its entries, and stays where it is between rounds.

* ``_sums``: the new entries come from the members at their owners. The bucketed
  scan needs no shuffle; only one row of sums per (position, entry, salt) moves.
* ``_movers``: every owner compares its members with the new codebooks (sent to
  the tasks: positions x entries x length numbers, bounded by parameters) and gives
  out only parts whose entry changes, as a record that leaves the old
  entry and one that joins the new one. Just these are shuffled, and appended as
  further files of their buckets.
* A part's last record in a bucket tells whether it is a member: an ordered
  window by (position, entry, salt, row), which the bucketing serves without a
  shuffle and which streams, so no task holds a group.

The salt (a hash of the row) splits an entry that holds a large part of all parts.
The table is written to the shared folder; a lost executor costs a re-read of
its buckets and of the round's movers.

Defined results: vectors that are null, shorter than the table's longest or
hold a null or non-finite entry are dropped; entries of 131,072 or more are an error
(``vectors.py``). Rows that repeat, or share an id, are rows of their own; the
first codebooks take the smallest (id, vector) in order, nulls last, and have
fewer entries when there are fewer rows. A dimension that the parts do not
divide is an error; an empty table gives no rows. Other columns pass through, those
named like an added one are replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clusterlens.llm import shared, vectors
from clusterlens.sources.tables import table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SALTS = 16
_ROWS = 1 << 11  # parts compared with a codebook at a time
_KEY = ["pos", "entry", "salt"]
_MEMBERS = "row long, pos int, entry int, salt int, round int, step int, v array<int>"


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part, ties to the lower entry; exact."""
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    exact = parts.shape[1] * (2 * most) ** 2 < 1 << 53  # then sums of doubles are integers without rounding
    entry, dist = np.empty(len(parts), np.int32), np.empty(len(parts), np.int64)
    for at in range(0, len(parts), _ROWS):
        rows = parts[at:at + _ROWS]
        if exact:
            a, b = rows.astype(np.float64), book.astype(np.float64)
            d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
        else:
            d = np.stack([((rows - b) ** 2).sum(1) for b in book], 1)
        best = d.argmin(1)
        entry[at:at + _ROWS], dist[at:at + _ROWS] = best, d[np.arange(len(rows)), best]
    return entry, dist


def _arrow(kind: str) -> list[tuple[str, pa.DataType]]:
    types = {"long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
    return [(name, types[t]) for name, t in (f.split(" ") for f in kind.split(", "))]


def _batch(kind: str, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in
                                       zip(cols, _arrow(kind), strict=True)], names=[n for n, _ in _arrow(kind)])


def _lists(m: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(m.reshape(-1).astype(np.int32)))


def _stacked(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _first_members(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """Every part of ``kept`` (row, salt, x) with its entry in ``books``."""
    parts, _, length = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _stacked(batch.column(2))
            n = len(x)
            for p in range(parts):
                v = np.ascontiguousarray(x[:, p * length:(p + 1) * length])
                yield _batch(_MEMBERS, batch.column(0), np.full(n, p), nearest(v, books[p])[0], batch.column(1),
                             np.zeros(n), np.ones(n), _lists(v))

    return kept.select("row", "salt", "x").mapInArrow(run, _MEMBERS)


def _members(records: DataFrame) -> DataFrame:
    """The present members: parts whose last record at their owner joins it."""
    later = F.lead("step").over(Window.partitionBy(*_KEY, "row").orderBy("round"))
    return records.withColumn("_later", later).where("step = 1 AND _later IS NULL").drop("_later")


def _sums(records: DataFrame, length: int) -> DataFrame:
    """(pos, entry, n, s: sum of every place) over the members: a record that
    leaves takes away what the one that joined added."""
    adds = [F.sum(F.col("step") * F.col("v")[i].cast("bigint")).alias(f"s{i}") for i in range(length)]
    owned = records.groupBy(*_KEY).agg(F.sum("step").alias("n"), *adds)
    total = owned.groupBy("pos", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(length)])
    return total.where("n > 0").select("pos", "entry", "n", F.array(*[f"s{i}" for i in range(length)]).alias("s"))


def _movers(members: DataFrame, books: np.ndarray, round_: int) -> DataFrame:
    """Two records, leaving and joining, of each member whose entry changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, old = (batch.column(i).to_numpy() for i in (1, 2))
            for p in np.unique(pos):
                at = np.flatnonzero(pos == p)
                v = _stacked(batch.column(5).take(pa.array(at)))
                new, _ = nearest(v, books[p])
                moved = new != old[at]
                row, salt = (batch.column(i).take(pa.array(at[moved])) for i in (0, 3))
                n = len(row)
                for entry, step in ((old[at[moved]], -1), (new[moved], 1)):
                    yield _batch(_MEMBERS, row, np.full(n, p), entry, salt, np.full(n, round_), np.full(n, step),
                                 _lists(v[moved]))

    return members.select("row", *_KEY, "round", "v").mapInArrow(run, _MEMBERS)


_CODES = "row long, pos int, entry int, dist long"


def _codes(members: DataFrame, books: np.ndarray) -> DataFrame:
    """(row, pos, entry, dist) of every member against the final codebooks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos = batch.column(1).to_numpy()
            for p in np.unique(pos):
                at = pa.array(np.flatnonzero(pos == p))
                entry, dist = nearest(_stacked(batch.column(2).take(at)), books[p])
                yield _batch(_CODES, batch.column(0).take(at), np.full(len(entry), p), entry, dist)

    return members.select("row", "pos", "v").mapInArrow(run, _CODES)


class Members:
    """The bucketed table of one run (an external table of the shared folder)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.name = spark, f"resident_members_{uuid.uuid4().hex}"
        self.path = shared.new_folder(spark, "members")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def create(self, records: DataFrame) -> None:
        (records.repartition(self.buckets, *_KEY).write.option("path", self.path)
         .bucketBy(self.buckets, *_KEY).format("parquet").saveAsTable(self.name))

    def append(self, records: DataFrame) -> None:
        records.repartition(self.buckets, *_KEY).write.insertInto(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _replaced(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Codebooks with every entry that has members replaced by floor(sum / n)."""
    new = books.copy()
    for r in sums.collect():  # positions x entries rows at most
        new[r["pos"], r["entry"]] = [s // r["n"] for s in r["s"]]
    return new


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(rows: DataFrame, id_col: str = "vec_id", col: str = "embedding", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(``rows`` with their entries ``codes`` (array, by position) and ``error``; the
    final codebooks as positions x entries x length)."""
    spark = rows.sparkSession
    rows = shared.without(rows, "codes", "error")
    dim = vectors.dimension(rows, col)
    if dim % parts:
        raise ValueError(f"{parts} parts do not divide {dim} entries")
    kept = shared.packed(rows.where(vectors.usable(col, dim)), vector=F.col(f"`{col}`"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = vectors.matrix(batch.column(1), dim)
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(x)], names=["own", "x"])

    own_type = kept.schema["row"].dataType.simpleString()
    kept = kept.mapInArrow(whole, f"own {own_type}, x array<int>")
    kept = kept.withColumn("row", F.monotonically_increasing_id())
    kept = shared.written(kept.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")), "vectors")
    first = kept.orderBy(F.col(f"own.`{id_col}`").asc_nulls_last(), "x").select("x").limit(entries).collect()
    result = [F.col(f"own.`{c}`") for c in rows.columns]
    if not first:
        return kept.select(*result, F.array().cast("array<int>").alias("codes"), F.lit(0).cast("bigint").alias("error")), \
            np.zeros((parts, 0, 0), np.int64)
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2)
    members = Members(spark)
    members.create(_first_members(kept, books))
    for t in range(1, rounds + 1):
        books = _replaced(books, _sums(members.read(), dim // parts))
        if t < rounds:
            members.append(_movers(_members(members.read()), books, t))
    codes = shared.written(_codes(_members(members.read()), books), "codes")
    members.drop()
    by_row = codes.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "entry"))).alias("codes"),
                                      F.sum("dist").alias("error"))
    out = kept.select("row", "own").join(by_row, "row")
    return out.select(*result, F.col("codes.entry").alias("codes"), "error"), books


def op12_resident_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every vector of ``embeddings``."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    out, books = compress(rows)
    digits = F.transform("codes", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0"))
    out = out.withColumn("same", F.concat(F.when(F.col("label").isNull(), "none").otherwise("of "),
                                          F.coalesce(F.col("label").cast("string"), F.lit(""))))
    by_label = out.groupBy("same").agg(F.sum("error").alias("label_error"))
    out = shared.lookup(out.select("vec_id", F.array_join(digits, "").alias("code"), "error", "same"), "same", by_label,
                        "vec_id")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """DuckDB: the rounds written out, distances by inner products (integers
    that doubles hold exactly), nearest entry by the least distance * 256 + entry."""
    steps = [f"""
kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, x, len(x) // {PARTS} AS w FROM (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * {vectors.SCALE})) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = (SELECT max(len(embedding)) FROM embeddings)
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)),
parts AS MATERIALIZED (SELECT r, k, x[k * w + 1:k * w + w] AS v FROM kept, range({PARTS}) t(k)),
c0 AS MATERIALIZED (SELECT k, e, x[k * w + 1:k * w + w] AS v FROM (
  SELECT x, w, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM kept) s, range({PARTS}) t(k)
  WHERE e < {ENTRIES})"""]
    for t in range(ROUNDS + 1):
        steps.append(f"""
a{t} AS MATERIALIZED (SELECT r, k, m % {ENTRIES} AS e, m // {ENTRIES} AS d FROM (
  SELECT r, p.k, min((list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v))::BIGINT
    * {ENTRIES} + c.e) AS m FROM parts p JOIN c{t} c ON p.k = c.k GROUP BY r, p.k))""")
        if t < ROUNDS:
            steps.append(f"""
c{t + 1} AS MATERIALIZED (SELECT c.k, c.e, coalesce(n.v, c.v) AS v FROM c{t} c LEFT JOIN (
  SELECT k, e, list(floor(s / n) ORDER BY i) AS v FROM (
    SELECT k, e, i, sum(y) AS s, count(*) AS n FROM (
      SELECT a.k, a.e, unnest(p.v) AS y, unnest(range(len(p.v))) AS i FROM a{t} a JOIN parts p ON a.r = p.r AND a.k = p.k)
    GROUP BY k, e, i) GROUP BY k, e) n ON c.k = n.k AND c.e = n.e)""")
    return "WITH " + ",".join(steps) + f""",
codes AS (SELECT r, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY k) AS code, sum(d)::BIGINT AS error
  FROM a{ROUNDS} GROUP BY r),
book AS (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY k, e, i)) AS h FROM (
  SELECT k, e, unnest(v) AS y, unnest(range(len(v))) AS i FROM c{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM kept JOIN codes ON kept.r = codes.r, book
"""


OP12_SQL = _sql()
