import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterlens.llm import polar_whitening as W
from clusterlens.llm import resident_codes as C

NAN, INF = float("nan"), float("inf")


def random_rows(n, dim, seed=5):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) * 0.3).astype(np.float32)
    rows = [(i, [float(c) for c in v], i % 3 or None) for i, v in enumerate(x)]
    odd = [(None, rows[3][1], 1), (7, rows[7][1], 1), (7, rows[8][1], None), (90, None, 1), (91, [NAN] * dim, 1),
           (92, [INF] + [0.0] * (dim - 1), 1), (93, [None] + [0.0] * (dim - 1), 2), (94, [0.5] * (dim - 1), 2), (95, [], 2)]
    return rows + odd


@pytest.fixture()
def embeddings(spark):
    def make(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        return df.withColumns({c: F.lit("own") for c in ("row", "n", "own", "salt", "x", "whitened", "codes", "error", "at", "entry")})

    return make


def usable(rows):
    dim = max((len(v) for _, v, _ in rows if v is not None), default=0)
    return [(i, v, z) for i, v, z in rows
            if v is not None and len(v) == dim > 0 and all(c is not None and math.isfinite(c) for c in v)]


def test_whitening_equals_dense_algebra(embeddings):
    rows = random_rows(300, 10)
    kept = usable(rows)
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v, _ in kept])
    n, total = len(x), x.sum(0)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    w = ((x - total / n) @ axes / np.sqrt(values))[:, ::-1][:, :8]
    df = embeddings(rows).repartition(3)
    model = W.fit(df)
    assert (model.n, model.means) == (n, (total // n).tolist())
    got = defaultdict(list)
    for r in W.whitened(df, model).collect():
        assert r.n == n and r.label is None or r.label in (1, 2)
        got[r.vec_id, int(r.deviation_exact)].append((r.component, r.whitened, r.explained))
    want = Counter((i, int(((n * v.astype(object) - total) ** 2).sum())) for (i, _, _), v in zip(kept, x))
    assert {k: len(v) for k, v in got.items()} == {k: 8 * m for k, m in want.items()}
    sign = np.sign((model.axes * axes[:, ::-1][:, :8]).sum(0))
    for (i, _, _), v, e in zip(kept, x, w):
        mine = sorted(got[i, int(((n * v.astype(object) - total) ** 2).sum())])
        assert any(np.allclose([m[1] for m in mine[k::len(mine) // 8]], e * sign, atol=1e-9) for k in range(len(mine) // 8))
    assert np.allclose(model.explained(), values[::-1][:8] / values.sum(), rtol=1e-9)
    assert W.identity_error(df, model) < 1e-9


def test_whitening_sums_are_exact(embeddings):
    rows = [(i, [float((-1) ** i * 131000 + i), float(i) / 7, -131071.5], None) for i in range(40)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v, _ in rows]).astype(object)
    n, total = len(x), x.sum(0)
    model = W.fit(embeddings(rows))
    z = n * x - total
    for a in range(3):
        for b in range(3):
            assert model.covariance[a, b] == float(int((z[:, a] * z[:, b]).sum()) / n ** 3)
    out = W.whitened(embeddings(rows), model)
    assert {(r.vec_id, int(r.deviation_exact)) for r in out.collect()} == set(enumerate((z ** 2).sum(1)))
    assert {r.component for r in out.where("whitened IS NULL").collect()} == {3}  # the constant dimension
    assert W.identity_error(embeddings(rows), model) < 1e-6


def test_whitening_edges(spark, embeddings):
    assert W.fit(embeddings([(1, None, 1), (2, [], 1)])) is None and W.fit(embeddings([]).limit(0)) is None
    one = W.fit(embeddings([(1, [0.25, 1.0], 1)]))
    assert [r.whitened for r in W.whitened(embeddings([(1, [0.25, 1.0], 1)]), one).collect()] == [None, None]
    assert W.identity_error(embeddings([(1, [0.25, 1.0], 1)]), one) is None
    with pytest.raises(Exception, match="reaches"):
        W.fit(embeddings([(1, [3e38], 1)]))


def lloyd(rows, parts, entries, rounds):
    """(code, error) by kept row, and the codebooks, in plain Python integers."""
    kept = [(i, [math.floor(1024 * c) for c in v], z) for i, v, z in usable(rows)]
    size = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * size:(p + 1) * size]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c)), e) for e, c in enumerate(books[p]))
                 for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), a in zip(kept, at) if a[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    return Counter((i, z, tuple(a[1] for a in at), sum(a[0] for a in at)) for (i, _, z), at in zip(kept, assign())), books


@pytest.mark.parametrize("parts,entries,rounds", [(2, 7, 4), (5, 300, 1), (1, 3, 6), (10, 16, 2)])
def test_codes_equal_plain_rounds(embeddings, parts, entries, rounds):
    rows = random_rows(120, 10, seed=parts)
    out, books = C.compress(embeddings(rows).repartition(3), parts=parts, entries=entries, rounds=rounds)
    want, plain = lloyd(rows, parts, entries, rounds)
    assert books.tolist() == plain
    assert Counter((r.vec_id, r.label, tuple(r.codes), r.error) for r in out.collect()) == want


def test_codes_of_large_entries_and_ties(embeddings):
    rows = [(i, [131071.0 * (-1) ** (i % 3), float(i % 2)], None) for i in range(30)]
    out, books = C.compress(embeddings(rows), parts=1, entries=4, rounds=3)
    want, plain = lloyd(rows, 1, 4, 3)
    assert books.tolist() == plain and Counter((r.vec_id, r.label, tuple(r.codes), r.error) for r in out.collect()) == want


def test_only_movers_are_appended(spark, embeddings, monkeypatch):
    sizes = []
    append = C.Members.append
    monkeypatch.setattr(C.Members, "append", lambda self, df: (append(self, df), sizes.append(
        self.read().groupBy("round").count().orderBy("round").collect()))[0])
    out, _ = C.compress(embeddings(random_rows(200, 8)), parts=2, entries=8)
    assert out.count() and all(s[-1]["count"] < s[0]["count"] for s in sizes)
    assert not spark.catalog.listTables("default") or all("resident" not in t.name for t in spark.catalog.listTables())


def test_members_are_read_without_a_shuffle(spark, embeddings, monkeypatch):
    plans = []
    monkeypatch.setattr(C.Members, "drop", lambda self: plans.extend(
        df._jdf.queryExecution().executedPlan().toString() for df in (C._members(self.read()), C._sums(self.read(), 4))))
    C.compress(embeddings(random_rows(50, 8)), parts=2, entries=4, rounds=2)
    assert "Exchange" not in plans[0] and plans[1].count("Exchange") == 1 and "Bucketed: true" in plans[0]


def test_codes_edges(embeddings):
    out, books = C.compress(embeddings([(1, None, 1), (2, [], 1)]))
    assert out.count() == 0 and books.size == 0
    assert {"vec_id", "codes", "error"} <= set(out.columns)
    with pytest.raises(ValueError, match="divide"):
        C.compress(embeddings([(1, [0.1] * 6, 1)]))
    with pytest.raises(Exception, match="reaches"):
        C.compress(embeddings([(1, [3e38] * 4, 1)]))
    assert C.books_digest(np.array([[[1, -2]], [[3, 4]]])) == hashlib.sha256(b"1,-2,3,4").hexdigest()


def test_codes_equal_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    rel = con.sql(C.OP12_SQL)
    got = C.op12_resident_codes(spark, d).select(*rel.columns).collect()
    assert Counter(map(tuple, got)) == Counter(rel.fetchall())
    one = W.op11_polar_whitening(spark, d)
    assert one.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert one.count() == 8 * len(got) and one.where("identity_error > 1e-4 OR deviation <> deviation_exact").count() == 0
