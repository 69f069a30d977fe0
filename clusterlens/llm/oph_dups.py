"""Operator 8: near-duplicate documents by one-permutation hashing.

1. *Sketch* (one scan): a document's set of word shingles is hashed once; the
   smallest hash of each of BANDS * ROWS bins is kept, empty bins copy a
   non-empty one by a probe sequence that depends on the bin alone (optimal
   densification), and every ROWS bins make one band hash.
2. *Classes*: documents with equal sets (128-bit fingerprint of the set) are
   one class, represented by its smallest id; only representatives go on.
3. *Buckets*: representatives with an equal band hash. A bucket proposes a
   star, not pairs: its hub (the member whose buckets are largest, so the text
   that the others are copies of) with each other member.
4. *Confirmation*: a proposed edge is a link when the full shingle sets have
   ``100 * intersection >= threshold * union``.
5. *Components* of the links. Buckets of more than SMALL members propose stars
   around further hubs, each member at most once, as long as a round brings
   them a link, for at most ROUNDS rounds.
6. *Rest*: in every bucket whose members are not yet all in one component, all
   pairs across components that no hub has met are compared, in tiles of
   blocks of members: no pair of a bucket is left out, whatever its size.

Groups that may hold a third of all rows (equal sets, a bucket, a hub's
members, a component) are combined map-side and joined with salts
(``shared.py``); texts are shuffled for the candidates only, and everything
read twice is a written table.

Defined results: a text without words (null, empty, white space) has an empty
set and is linked with nothing; a text of fewer words than a shingle is one
shingle; rows of one doc_id are one document; a row without doc_id gets a
hash of its text as id, its component_id is then that hash if it is the
smallest; ties of hubs go to the smallest id; an empty table gives an empty
table; further columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm import shared
from clusterlens.llm import words as W
from clusterlens.llm.components import components, merged
from clusterlens.sources.tables import table

WORDS = 5
THRESHOLD = 80  # per cent
BANDS, ROWS = 32, 5
SMALL = 1024  # a bucket of at most so many members has one hub before all its pairs are compared
HUBS = 4  # hubs a round in larger buckets, after the first round
ROUNDS = 4  # of them at most; they only save work for the complete comparison that follows
TILE = 256  # members of a block whose pairs are compared in one task
COLUMNS = 4096  # shingles of a tile that are counted at once
_U = np.uint64
_FULL = _U(0xFFFFFFFFFFFFFFFF)


class Sketcher:
    """Set size, set fingerprint and band hashes of each row of a block."""

    def __init__(self, k: int, bands: int = BANDS, rows: int = ROWS):
        self.k, self.bands, self.rows, self.bins = k, bands, rows, bands * rows
        self.words = W.SpanHash(81, lower=True)

    def probe(self, attempt: int) -> np.ndarray:
        i = np.arange(self.bins, dtype=_U) + _U(attempt * self.bins)
        return (W.mix(i, 9) % _U(self.bins)).astype(np.int64)

    def __call__(self, b: W.Block):
        n, bins = len(b), self.bins
        h, r = W.shingle_sets(b, self.words, self.k)
        size = W.per_row(r, n)
        one, two = np.zeros(n, _U), np.zeros(n, _U)
        with np.errstate(over="ignore"):
            np.add.at(one, r, W.mix(h, 11))
            np.add.at(two, r, W.mix(h, 12))
        v = W.mix(h, 13)
        cell = r * bins + ((v >> _U(32)) * _U(bins) >> _U(32)).astype(np.int64)
        flat = np.full(n * bins, _FULL, _U)
        np.minimum.at(flat, cell, W.mix(h, 14))
        sketch = flat.reshape(n, bins)
        filled = sketch != _FULL
        rows, cols = np.nonzero(~filled & (size > 0)[:, None])
        for attempt in range(1, 4 * bins):
            if not len(rows):
                break
            to = self.probe(attempt)[cols]
            hit = filled[rows, to]
            sketch[rows[hit], cols[hit]] = sketch[rows[hit], to[hit]]
            rows, cols = rows[~hit], cols[~hit]
        if len(rows):  # the first non-empty bin to the right
            at = np.where(filled, np.arange(bins), bins)
            first = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1]
            nxt = first[rows, cols]
            nxt = np.where(nxt < bins, nxt, first[rows, 0])
            sketch[rows, cols] = sketch[rows, nxt]
        band = np.repeat(W.mix(np.arange(self.bands), 15)[None, :], n, axis=0)
        parts = sketch.reshape(n, self.bands, self.rows)
        for j in range(self.rows):
            band = W.mix(band ^ parts[:, :, j], 16)
        return size, one, two, band


def row_id(doc_id: str, text: str) -> Column:
    return F.coalesce(F.col(f"`{doc_id}`"), F.xxhash64(F.col(f"`{text}`"))).cast("bigint")


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(id, n, f1, f2, bands) of ``docs`` (id, text); bands is null when the
    set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(words, bands, rows)
        for batch in batches:
            for b in W.blocks(batch.column(1)):
                size, one, two, band = sketcher(b)
                has = size > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[has].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.first, len(b)), pa.array(size), pa.array(one.view(np.int64)),
                     pa.array(two.view(np.int64)), lists], names=["id", "n", "f1", "f2", "bands"])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, f1 long, f2 long, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """Of ``pairs`` (hub, cid), those whose texts (id, text) have similar sets."""
    members = pairs.join(texts.select(F.col("id").alias("cid"), F.col("text").alias("t_cid")), "cid")
    members = members.withColumn("salt", shared.salt(F.col("cid")))
    hubs = pairs.withColumn("salt", shared.salt(F.col("cid"))).groupBy("hub").agg(shared.salt_mask().alias("salts"))
    hubs = shared.by_salt(hubs.join(texts.select(F.col("id").alias("hub"), F.col("text").alias("t_hub")), "hub"))
    both = members.join(hubs, ["hub", "salt"]).select("hub", "cid", "t_hub", "t_cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = W.SpanHash(81, lower=True)
        for batch in batches:
            if not batch.num_rows:
                continue
            hub = batch.column(0).to_numpy(zero_copy_only=False)
            cid = batch.column(1).to_numpy(zero_copy_only=False)
            new = np.ones(len(hub), bool)
            new[1:] = hub[1:] != hub[:-1]
            sets = _sets(batch.column(2).take(pa.array(np.flatnonzero(new))), hasher, words)
            mine, at, ok = None, -1, []
            hubs_of = np.cumsum(new) - 1
            for i, other in enumerate(_sets(batch.column(3), hasher, words)):
                while at < hubs_of[i]:
                    mine, at = next(sets), at + 1
                a, z = (mine, other) if len(mine) <= len(other) else (other, mine)
                if 100 * len(a) < threshold * len(z) or not len(a):
                    ok.append(False)
                    continue
                where = np.searchsorted(z, a)
                both = int((z[np.minimum(where, len(z) - 1)] == a).sum())
                ok.append(100 * both >= threshold * (len(a) + len(z) - both))
            keep = np.array(ok)
            yield pa.RecordBatch.from_arrays([pa.array(hub[keep]), pa.array(cid[keep])], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _sets(column: pa.Array, hasher: W.SpanHash, words: int) -> Iterator[np.ndarray]:
    for b in W.blocks(column):
        h, r = W.shingle_sets(b, hasher, words)
        of = W.bounds(r, len(b))
        for i in range(len(b)):
            yield h[of[i]:of[i + 1]]


def _open(members: DataFrame, comps: DataFrame, hubs: DataFrame, gained: DataFrame | None) -> DataFrame:
    """Members (bucket, cid, score, size, n, comp, used) of the buckets of more
    than SMALL members that take a further round of hubs: their members lie in
    several components and the last round brought a link (``gained``: the
    nodes of new links). ``used``: the member was a hub of the bucket."""
    m = members.where(F.col("size") > SMALL)
    m = m.join(comps.select(F.col("node").alias("cid"), "comp"), "cid", "left")
    if gained is not None:
        m = m.join(gained.withColumn("new", F.lit(1)), "cid", "left")
    else:
        m = m.withColumn("new", F.lit(1))
    m = m.join(hubs.withColumn("used", F.lit(1)), ["bucket", "cid"], "left")
    m = m.withColumn("comp", F.coalesce("comp", "cid")).withColumn("salt", shared.salt(F.col("cid")))
    state = m.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("new").alias("new"),
                                    shared.salt_mask().alias("salts"))
    state = state.where((F.col("lo") != F.col("hi")) & F.col("new").isNotNull())
    return m.drop("new").join(shared.by_salt(state.select("bucket", "salts")), ["bucket", "salt"])


def _tiles(members: DataFrame, comps: DataFrame, hubs: DataFrame) -> DataFrame:
    """(tile, cid, comp): every two members of a bucket that lie in different
    components and were not compared yet meet in a tile. Members that were
    hubs (bucket, cid) are done; of buckets with the same members left, one is
    taken. A bucket's members are dealt to blocks of about TILE; a component
    of more gets blocks of its own, which need not meet each other."""
    m = members.join(hubs, ["bucket", "cid"], "left_anti")
    m = m.join(comps.select(F.col("node").alias("cid"), "comp"), "cid", "left")
    m = m.select("bucket", "cid", F.coalesce("comp", "cid").alias("comp"), F.expr("1 + n div 1000").alias("w"))
    m = shared.written(m.withColumn("salt", shared.salt(F.col("cid"))), "left")
    each = m.groupBy("bucket", "comp").agg(
        F.sum("w").alias("w"), F.bit_xor(F.xxhash64("cid")).alias("f1"),
        F.bit_xor(F.xxhash64(F.lit("2"), "cid")).alias("f2"), shared.salt_mask().alias("salts"))
    state = each.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("k"), F.sum("w").alias("all"),
        F.sum(F.when(F.col("w") <= TILE, F.col("w")).otherwise(0)).alias("mixed"),
        F.bit_xor("f1").alias("f1"), F.bit_xor("f2").alias("f2"), F.bit_or("salts").alias("salts"))
    state = state.where("k > 1").groupBy("f1", "f2", "all").agg(
        F.min_by(F.struct("bucket", "mixed", "salts"), "bucket").alias("s")).select("s.*", "all")
    m = shared.written(m.join(shared.by_salt(state), ["bucket", "salt"]), "left")
    whole = m.where(F.col("all") <= TILE).select(F.col("bucket").alias("tile"), "cid", "comp")

    m = m.where(F.col("all") > TILE).drop("salt").withColumn("bc", F.xxhash64("bucket", "comp"))
    big = m.groupBy("bc").agg(F.sum("w").alias("own")).where(F.col("own") > TILE)
    m = shared.lookup(m, "bc", big, "cid")
    deal = F.pmod(F.xxhash64(F.lit("block"), "cid"), F.ceil(F.coalesce("own", "mixed") / F.lit(TILE)))
    pure = F.when(F.col("own").isNotNull(), F.col("comp"))
    m = m.select("bucket", "cid", "comp", pure.alias("pure"), F.xxhash64(F.col("own").isNull(), pure, deal).alias("block"))
    m = shared.written(m.withColumn("salt", shared.salt(F.col("cid"))), "blocks")
    blocks = shared.written(m.groupBy("bucket", "block").agg(F.max("pure").alias("pure"), shared.salt_mask().alias("salts")),
                            "blocks")
    other = blocks.select("bucket", F.col("block").alias("block2"), F.col("pure").alias("pure2"))
    side = blocks.join(other, "bucket").where("block <> block2 AND NOT coalesce(pure = pure2, false)")
    tile = F.xxhash64("bucket", F.least("block", "block2"), F.greatest("block", "block2"))
    side = shared.by_salt(side.select("bucket", "block", "salts", tile.alias("tile")))
    split = m.join(side, ["bucket", "block", "salt"])
    return whole.union(split.select("tile", "cid", "comp"))


def _complete(tiles: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """Links (a, b) between members of different components of each tile: a
    spanning forest of the pairs with similar sets, all of them compared."""
    rows = tiles.join(texts.withColumnRenamed("id", "cid"), "cid").repartition("tile").sortWithinPartitions("tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = W.SpanHash(81, lower=True)
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)]])
            cid, comp = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            sets = _sets(batch.column(3), hasher, words)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tile[lo] != now:
                    yield _similar(held, threshold)
                    held = []
                now = tile[lo]
                held += [(cid[i], comp[i], next(sets).copy()) for i in range(lo, hi)]
        if held:
            yield _similar(held, threshold)

    return rows.select("tile", "cid", "comp", "text").mapInArrow(run, "a long, b long")


def _similar(members: list[tuple[int, int, np.ndarray]], threshold: int) -> pa.RecordBatch:
    """Spanning forest of the similar pairs of ``members`` (cid, comp, set)."""
    cid, comp = (np.array([m[j] for m in members], np.int64) for j in (0, 1))
    size = np.array([len(m[2]) for m in members], np.int64)
    who = np.repeat(np.arange(len(members)), size)
    of, count = np.unique(np.concatenate([m[2] for m in members]), return_inverse=True, return_counts=True)[1:]
    shared_by_two = count > 1  # others are in no intersection
    rank = np.cumsum(shared_by_two) - 1
    use = shared_by_two[of]
    who, col = who[use], rank[of[use]]
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    both = np.zeros((len(members), len(members)), np.float64)
    for lo in range(0, int(shared_by_two.sum()), COLUMNS):
        i, j = np.searchsorted(col, [lo, lo + COLUMNS])
        has = np.zeros((len(members), COLUMNS), np.float32)
        has[who[i:j], col[i:j] - lo] = 1
        both += has @ has.T
    link = 100 * both >= threshold * (size[:, None] + size[None, :] - both)
    link &= comp[:, None] != comp[None, :]
    a, b, seen = [], [], np.zeros(len(members), bool)
    for root in np.flatnonzero(link.any(axis=1)):
        todo = [] if seen[root] else [root]
        seen[root] = True
        while todo:
            i = todo.pop()
            near = np.flatnonzero(link[i] & ~seen)
            seen[near] = True
            a += [i] * len(near)
            b += near.tolist()
            todo += near.tolist()
    at_a, at_b = np.array(a, np.int64), np.array(b, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(cid[at_a]), pa.array(cid[at_b])], names=["a", "b"])


def near_classes(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, bands: int = BANDS,
                 rows: int = ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, links, comps) of ``docs`` (id, text): classes (id, n, cid)
    gives each row its set size and the smallest id with the same set; links
    (a, b) are the confirmed edges between class representatives; comps (node,
    comp) gives each linked representative its component."""
    sk = shared.written(sketches(docs, words, bands, rows), "sketches")
    full = sk.where("n > 0").withColumn("salt", shared.salt(F.col("id")))
    same = full.groupBy("f1", "f2").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("c"),
                                        shared.salt_mask().alias("salts")).where("c > 1").drop("c")
    classes = full.join(shared.by_salt(same), ["f1", "f2", "salt"], "left")
    classes = classes.select("id", "n", F.coalesce("cid", "id").alias("cid"), "bands")
    classes = shared.written(classes.union(sk.where("n = 0").select("id", "n", F.col("id").alias("cid"), "bands")),
                             "classes")

    entry = classes.where("id = cid AND n > 0").select("cid", "n", F.explode("bands").alias("bucket"))
    entry = entry.withColumn("salt", shared.salt(F.col("cid")))
    bucket = entry.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), shared.salt_mask().alias("salts"))
    bucket = shared.by_salt(bucket.where("size > 1"))
    found = shared.written(entry.join(bucket, ["bucket", "salt"]).select("bucket", "cid", "size", "n").distinct(),
                           "buckets")
    score = found.groupBy("cid").agg(F.sum("size").alias("score"))
    members = shared.written(found.join(score, "cid"), "members")
    texts = docs.join(score.select(F.col("cid").alias("id")), "id", "left_semi")
    texts = shared.written(texts.groupBy("id").agg(F.min("text").alias("text")), "texts")

    tried = links = comps = hubs = gained = None
    live = members.withColumns({"comp": F.col("cid"), "salt": shared.salt(F.col("cid")), "used": F.lit(None).cast("int")})
    turn = 0
    while True:
        first = turn == 0
        slot = F.lit(0) if first else F.pmod(F.xxhash64("cid", F.lit(turn)), F.lit(HUBS))
        chosen = live.where("used IS NULL").withColumn("slot", slot).groupBy("bucket", "slot").agg(
            F.max_by(F.struct(F.col("cid").alias("hub"), F.col("comp").alias("hub_comp")),
                     F.struct("score", -F.col("cid"))).alias("h")).select("bucket", "h.*")
        chosen = shared.written(chosen, "hubs")
        mask = live.groupBy("bucket").agg(shared.salt_mask().alias("salts"))
        stars = live.join(shared.by_salt(chosen.join(mask, "bucket")), ["bucket", "salt"])
        pairs = stars.where("cid <> hub AND comp <> hub_comp").select("hub", "cid").distinct()
        if tried is not None:
            done = tried.union(tried.select(F.col("cid").alias("hub"), F.col("hub").alias("cid")))
            pairs = pairs.join(done, ["hub", "cid"], "left_anti")
        pairs = shared.written(pairs, "pairs")
        new = shared.written(confirmed(pairs, texts, words, threshold), "links")
        links = new if links is None else links.union(new)
        tried = pairs if tried is None else tried.union(pairs)
        used = chosen.select("bucket", F.col("hub").alias("cid"))
        hubs = used if hubs is None else hubs.union(used)
        comps = components(links) if first else merged(comps, new)
        gained = None if first else new.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        live = shared.written(_open(members, comps, hubs, gained), "open")
        if turn == ROUNDS or live.isEmpty():
            break
        turn += 1
    rest = shared.written(_complete(_tiles(members, comps, hubs), texts, words, threshold), "links")
    return classes.select("id", "n", "cid"), links.union(rest), merged(comps, rest)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                    threshold: int = THRESHOLD) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``."""
    rows = docs.select(row_id(doc_id, text).alias("id"), F.col(f"`{text}`").alias("text"))
    classes, _, comps = near_classes(rows, words, threshold)
    comps = comps.select(F.col("node").alias("cid"), "comp")
    out = shared.lookup(classes, "cid", comps, "id")
    out = out.select("id", F.col("n").alias("n_shingles"), F.coalesce("comp", "cid").alias("component_id"))
    return out.withColumn("kept", F.col("id") == F.col("component_id"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                         threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group of near duplicates."""
    gone = near_duplicates(docs, doc_id, text, words, threshold).where("NOT kept")
    return shared.without_ids(docs, row_id(doc_id, text), gone)


def op8_oph_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents``, four-word shingles."""
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4)
    return out.withColumnRenamed("id", "doc_id")


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(ws) - 2, 2)),
        lambda i: array_to_string(list_slice(ws, i, i + 3), ' ')))) AS sh FROM w WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id
      GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id
      WHERE 100 * inter >= 80 * (x.n + y.n - inter)),
g AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS a, a AS b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a),
c AS (SELECT a, min(b) AS comp FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.comp, w.doc_id)::BIGINT AS component_id,
  w.doc_id = coalesce(c.comp, w.doc_id) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.a
"""
