import math
from collections import Counter

import duckdb
import pytest

from clusterlens.llm import poisson_mix as P


def rows_of(documents, n=600):
    rows = [(i, "word " * (i % 40)) for i in range(n)]
    return documents(rows)


def test_counts_follow_the_rates(documents):
    docs = rows_of(documents, 3000)
    weights, rest = {"src0": 0.7, "src1": 0.1}, 0.2
    rates = {r.grp: r.rate for r in P.rates(docs, weights, rest, 2.0).collect()}
    out = P.poisson_mix(docs, weights, rest, 2.0)
    assert out.columns == [*(c for c in docs.columns if c != "copy"), "copy", "shuffle_key"]
    n = Counter((r.source, r.doc_id) for r in out.collect())
    for source, grp in (("src0", "src0"), ("src1", "src1"), ("src2", None)):
        copies = [n[source, i] for i in range(3000) if f"src{i % 3}" == source]
        mean = sum(copies) / len(copies)
        var = sum((c - mean) ** 2 for c in copies) / len(copies)
        assert abs(mean - rates[grp]) < 5 * math.sqrt(rates[grp] / len(copies))
        assert abs(var / rates[grp] - 1) < 0.25


def test_draw_is_the_inverse_of_the_distribution(spark):
    for rate in (0.0, 0.3, 1.0, 7.5, 900.0):
        cdf = spark.range(1).select(P.cumulative(P.F.lit(rate)).alias("c")).first().c
        assert cdf[-1] == pytest.approx(1, abs=1e-9) and all(a <= b for a, b in zip(cdf, cdf[1:]))
        k = min(len(cdf) - 1, int(rate))
        want = sum(math.exp(i * math.log(rate) - rate - math.lgamma(i + 1)) if rate else float(i == 0) for i in range(k + 1))
        assert cdf[k] == pytest.approx(want, rel=1e-9)


def test_order_is_global_and_repeatable(documents):
    docs = rows_of(documents)
    a = P.poisson_mix(docs, budget=3.0)
    keys = [r.shuffle_key for r in a.collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    b = P.poisson_mix(docs.repartition(7), budget=3.0)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_nulls_and_limits(documents):
    docs = documents([(None, None), (None, "x y"), (5, ""), (6, "one two"), (6, "one two")])
    out = P.poisson_mix(docs, {}, 1.0, 40.0).collect()
    twins = Counter((r.doc_id, r.copy) for r in out if r.doc_id == 6)
    assert set(twins.values()) == {2} and len({r.text for r in out}) >= 3
    assert P.poisson_mix(docs.where("false")).count() == 0
    assert P.poisson_mix(docs, {"src0": 1.0}, 0.0).where("source <> 'src0'").count() == 0
    with pytest.raises(ValueError):
        P.rates(docs, {"a": -1.0})


def test_a_large_rate_is_drawn_in_parts(documents, monkeypatch):
    docs = rows_of(documents, 900)
    monkeypatch.setattr(P, "MAX_RATE", 2.0)
    n = Counter(r.doc_id for r in P.poisson_mix(docs, {}, 1.0, 7.0).select("doc_id").collect())
    counts = [n[i] for i in range(900)]
    mean = sum(counts) / 900
    assert abs(mean - 7) < 5 * math.sqrt(7 / 900)
    assert abs(sum((c - mean) ** 2 for c in counts) / 900 / 7 - 1) < 0.25  # the parts are independent
    a, b = (sorted((r.doc_id, r.copy) for r in P.poisson_mix(d, {}, 1.0, 7.0).collect()) for d in (docs, docs.repartition(5)))
    assert a == b


def test_plan_has_no_python_and_no_nested_loop(spark):
    plan = P.op7_poisson_mix(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian"))


def test_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    rel = con.sql(P.OP7_SQL)
    got = P.op7_poisson_mix(spark, d).select(*rel.columns).collect()
    assert Counter(map(tuple, got)) == Counter(rel.fetchall())
