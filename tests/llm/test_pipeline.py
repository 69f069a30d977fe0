"""The pipeline against a plain-Python run of the same five steps."""

import hashlib
import math
from collections import Counter

import corpus_pipeline as P
from clusterlens.llm import poisson_mix, shared
from tests.llm.test_decontam import brute as brute_leaks
from tests.llm.test_near_dups import brute as brute_groups
from tests.llm.test_quality_and_lines import brute_lines, brute_measures

DIR = "/root/testdata/sf0.001"


def passes(text):
    n, chars, symbols, dup, repeat, lines = brute_measures(text)
    return not (n < 10 or 100 * repeat > 20 * n or 10 * symbols > n or 2 * dup > lines or chars < 2 * n or chars > 12 * n)


def copies(doc_id, rate, seed=poisson_mix.SEED):
    def unit(*parts):
        return (int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    u, k, total, term = unit(seed, doc_id), 0, 0.0, 0.0
    while True:
        term += math.log(k) if k else 0.0
        total += math.exp(k * math.log(rate) - rate - term)
        if total > u:
            return [(c, unit(seed, doc_id, c)) for c in range(1, k + 1)]
        k += 1


def test_pipeline_equals_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    rows = [(d, r.text) for d, r in docs.items() if passes(r.text)]
    rows = [(d, t) for d, t, _, _ in brute_lines(rows)]
    rows = [(d, t) for d, t in rows if brute_groups_of(rows)[d][1] == d]
    leaks = {d for d, _ in brute_leaks(rows, items)}
    rows = [(d, t) for d, t in rows if d not in leaks]
    assert leaks
    size = Counter()
    for d, t in rows:
        size[docs[d].source if docs[d].source in poisson_mix.WEIGHTS else None] += len(t)
    weight = {**poisson_mix.WEIGHTS, None: poisson_mix.REST}
    total = sum(weight.values())
    want = Counter()
    for d, t in rows:
        grp = docs[d].source if docs[d].source in poisson_mix.WEIGHTS else None
        for c, key in copies(d, weight[grp] / total * sum(size.values()) / size[grp]):
            want[d, t, docs[d].lang, docs[d].source, len(t), c, key] += 1
    got = Counter(tuple(r) for r in P.run(spark, DIR).collect())
    assert got == want


_GROUPS: dict = {}


def brute_groups_of(rows):
    key = len(rows)
    if key not in _GROUPS:
        _GROUPS[key] = brute_groups(rows, 5)
    return _GROUPS[key]


def test_stages_keep_columns_and_handle_odd_rows(spark, documents):
    line = "a line that is long enough to count as one"
    rows = [(None, None), (1, ""), (2, "x"), (2, "x"), (3, " ".join(f"w{i}" for i in range(50))),
            (4, " ".join(f"w{i}" for i in range(51))), (5, " ".join(f"w{i}" for i in range(51))), (6, "t " * 3000)]
    rows += [(10 + i, f"{line}\nown words of document number {i} which go on and on for a while {i}") for i in range(4)]
    docs = documents(rows)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns, name
        docs = shared.written(out, "stage")
    assert {r.doc_id for r in docs.collect()} == {3, 10, 11, 12, 13}
    assert all(r.n_chars == len(r.text) for r in docs.where("doc_id >= 10").collect())
    mixed = P.STAGES[-1][1](spark, docs, DIR)
    assert set(mixed.columns) == set(docs.columns) | {"copy", "shuffle_key"}
    for name, stage in P.STAGES:
        assert stage(spark, documents(rows).where("false"), DIR).count() == 0, name


def test_five_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["quality rules", "line dedup", "near-duplicate removal",
                                        "benchmark decontamination", "mixing"]
