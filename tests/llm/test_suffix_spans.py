import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from clusterlens.llm import bwt
from clusterlens.llm import suffix_spans as S


def brute(texts, least):
    """(n_bytes, spans, kept) of each text."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - least + 1):
            if seen[t[i:i + least]] > 1:
                gone[i:i + least] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[:-1].astype(int), [0]])))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        out.append((len(t), tuple(spans), bytes(c for c, g in zip(t, gone) if not g)))
    return out


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(4, 40))) for _ in range(6)]
    texts = []
    for _ in range(n):
        bits = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(3)]
        texts.append(rng.choice([" ", "", "\n"]).join([bits[0], rng.choice(passages), bits[1], rng.choice(passages), bits[2]]))
    return texts + texts[:4] + [None, "", "a" * 130, "ab" * 70 + "b", passages[0][:90], "x" + passages[1]]


def rows_of(out):
    return Counter((r.doc_id, r.n_bytes, tuple((s["from"], s["to"]) for s in r.spans), bytes(r.kept), r.n_removed, r.n_spans)
                   for r in out.collect())


def expected(rows, least):
    return Counter((d, n, spans, kept, n - len(kept), len(spans)) for (d, _), (n, spans, kept) in
                   zip(rows, brute([t for _, t in rows], least)))


def test_transform_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        letters, least = rng.choice([b"a", b"ab", b"abcdxyz", bytes(range(256))]), rng.randint(1, 9)
        strings = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 8))]
        strings += [strings[0][2:], strings[0]] if strings and rng.random() < 0.5 else []
        times = np.array([rng.randint(1, 3) for _ in strings], np.int64)
        sizes = np.array([len(s) for s in strings], np.int64)
        seen = Counter()
        for s, t in zip(strings, times):
            for i in range(len(s) - least + 1):
                seen[s[i:i + least]] += t
        data = np.frombuffer(b"".join(strings), np.uint8)
        got = bwt.repeated_windows(data, np.cumsum(sizes) - sizes, np.cumsum(sizes), times, least)
        assert list(zip(*map(np.ndarray.tolist, got))) == [
            (k, i) for k, s in enumerate(strings) for i in range(len(s) - least + 1) if seen[s[i:i + least]] > 1]


def test_order_and_common_prefixes_are_those_of_the_suffixes():
    rng = random.Random(2)
    for _ in range(100):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 20))) for _ in range(5)]
        sizes = np.array([len(s) for s in strings])
        data = np.frombuffer(b"".join(strings), np.uint8)
        symbols, of, left = bwt.joined(data, np.cumsum(sizes) - sizes, np.cumsum(sizes))
        order = bwt.suffix_order(symbols, of, left)
        suffix = [strings[of[i]][len(strings[of[i]]) - left[i]:] for i in order]
        assert suffix == sorted(suffix)
        common = [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                        for a, b in zip(suffix, suffix[1:])]
        assert bwt.common_prefixes(symbols, order, 4).tolist() == [c if c < 4 else -1 for c in common]


@pytest.mark.parametrize("least,grams,contexts,piece", [(60, (16, 40), 1024, 1 << 20), (60, (8, 20), 2, 1 << 20),
                                                        (100, (99,), 1, 300), (50, (), 1024, 64), (1, (1,), 5, 1 << 20)])
def test_spans_equal_brute_force(documents, monkeypatch, least, grams, contexts, piece):
    monkeypatch.setattr(S, "CONTEXTS", contexts)
    monkeypatch.setattr(S, "_PIECE", piece)
    monkeypatch.setattr(S, "BLOCK_BYTES", 2000)
    runs = S.repeated_runs
    monkeypatch.setattr(S, "repeated_runs", lambda t, n, g=grams: runs(t, n, g))
    rows = list(enumerate(corpus(60 if least > 1 else 6)))
    assert rows_of(S.drop_repeated(documents(rows).repartition(3), least=least)) == expected(rows, least)


def test_repeated_rows_nulls_and_other_columns(documents):
    text = "".join(random.Random(9).choice("abcdef ") for _ in range(500))
    rows = [(1, text), (1, text), (None, text[:250]), (None, None), (2, ""), (3, text[100:299]), (4, "y" * 200), (5, "z" * 201),
            (6, text[100:300] + "!"), (7, "".join(random.Random(1).choice("gh") for _ in range(3000)))]
    df = documents(rows)
    out = S.drop_repeated(df)
    assert rows_of(out) == expected(rows, 200)
    assert out.columns == [*(c for c in df.columns if c != "text"), "kept", "spans", "n_bytes", "n_removed", "n_spans"] and out.first().row == "own row"
    assert S.drop_repeated(df.where("false")).count() == 0
    assert S.drop_repeated(documents([(1, None)])).first().n_removed == 0
    alone = S.drop_repeated(df.select("text"))
    assert Counter(r.n_removed for r in alone.collect()) == Counter(k[4] for k in expected(rows, 200).elements())


def test_one_long_text(documents):
    rng = random.Random(4)
    half = "".join(rng.choice("abcdefgh") for _ in range(700_000))
    rows = [(1, half + "é" + half[:650_000]), (2, "short"), (3, half[5:300])]
    got = {r.doc_id: r for r in S.drop_repeated(documents(rows)).collect()}
    assert [(s["from"], s["to"]) for s in got[1].spans] == [(0, 650_000), (700_002, 1_350_002)]
    assert (got[2].n_removed, got[3].n_removed) == (0, 295)


def test_texts_are_read_by_bucket(spark, documents):
    plan = S.drop_repeated(documents(list(enumerate(corpus(5)))), least=50)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and not any(x in plan for x in ("NestedLoop", "Cartesian"))


def test_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    rel = con.sql(S.OP13_SQL)
    got = S.op13_suffix_spans(spark, d).select(*rel.columns).collect()
    assert Counter(map(tuple, got)) == Counter(rel.fetchall())
