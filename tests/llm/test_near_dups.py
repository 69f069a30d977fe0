import random
import re
from collections import defaultdict

import pytest

from clusterlens.llm import components, oph_dups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def brute(rows, k, threshold=80):
    sets = defaultdict(set)
    for d, t in rows:
        sets[d] |= shingles(t, k)
    ids = sorted(sets)
    up = {d: d for d in ids}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus(rng, groups=6, size=25):
    """Groups of edited copies, some edits beyond the threshold, plus exact
    copies, short texts and unrelated ones that share a passage."""
    vocab = [f"w{i}" for i in range(3000)]
    rows, d = [], 0
    passage = " ".join(rng.choices(vocab, k=30))
    for g in range(groups):
        base = rng.choices(vocab, k=rng.choice([6, 40, 150]))
        for i in range(size):
            ws = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
            text = " ".join(ws)
            rows.append((d, text.upper() if i % 7 == 0 else text.replace(" ", "\n", 1)))
            d += 1
    for _ in range(40):
        rows.append((d, passage + " " + " ".join(rng.choices(vocab, k=rng.choice([2, 20, 60])))))
        d += 1
    for text in (None, "", " \n", "one", "ONE", "one two", "one two three", "two one", "x" * 5000, "x" * 5000):
        rows.append((d, text))
        d += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,seed", [(4, 1), (5, 2)])
def test_components_equal_brute_force(documents, k, seed):
    rows = corpus(random.Random(seed))
    got = {r.id: (r.n_shingles, r.component_id) for r in oph_dups.near_duplicates(documents(rows), words=k).collect()}
    assert got == brute(rows, k)


def test_kept_rows_and_columns(documents):
    rows = corpus(random.Random(5), groups=2)
    docs = documents(rows)
    kept = oph_dups.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in brute(rows, 5).items() if c == d}


def test_missing_ids_repeated_rows_and_empty_table(documents):
    text = "alpha beta gamma delta epsilon zeta"
    docs = documents([(3, text), (3, text), (None, text), (7, None), (7, None), (8, "")])
    got = oph_dups.near_duplicates(docs, words=4).collect()
    linked = {r.component_id for r in got if r.n_shingles}
    assert len(got) == 6 and len(linked) == 1 and {r.component_id for r in got if not r.n_shingles} == {7, 8}
    assert oph_dups.near_duplicates(docs.where("false")).count() == 0
    assert oph_dups.drop_near_duplicates(docs.where("false")).count() == 0


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(300, 301), (301, 302), (302, 300)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: 100 for n in range(100, 141)} | {n: 7 for n in [7, *range(200, 260)]} | {n: 300 for n in (300, 301, 302)}
    assert got == want
    first = components.components(spark.createDataFrame([(1, 2), (5, 6), (8, 9)], "a long, b long"))
    more = components.merged(first, spark.createDataFrame([(6, 9), (20, 2), (30, 31)], "a long, b long"))
    assert {r.node: r.comp for r in more.collect()} == {1: 1, 2: 1, 20: 1, 5: 5, 6: 5, 8: 5, 9: 5, 30: 30, 31: 30}
    assert components.components(first.where("false").selectExpr("node a", "comp b")).count() == 0


def test_densification_keeps_similarity():
    import pyarrow as pa

    from clusterlens.llm import words as W

    rng = random.Random(9)
    sk, same = oph_dups.Sketcher(1, bands=40, rows=1), []
    for _ in range(60):
        base = [f"t{rng.random()}" for _ in range(12)]
        b = next(W.blocks(pa.array([" ".join(base[:10]), " ".join(base[2:])])))  # Jaccard 8 / 12
        band = sk(b)[3]
        same.append((band[0] == band[1]).mean())
    assert abs(sum(same) / len(same) - 8 / 12) < 0.06


def test_components_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(components, "EDGES_PER_TASK", 10)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(300, 301), (301, 302)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(12)
    got = {r.node: r.comp for r in components.components(df).collect()}
    assert got == {n: 100 for n in range(100, 141)} | {n: 7 for n in [7, *range(200, 260)]} | {n: 300 for n in (300, 301, 302)}


def spread_group(size):
    """Pairs of near copies, (2 i, 2 i + 1), of one base: a document shares
    under 80 % with all but its partner, yet enough for common buckets."""
    rng = random.Random(11)
    base, rows = [f"b{i}" for i in range(200)], []
    for i in range(size // 2):
        ws = list(base)
        for at in rng.sample(range(200), 9):
            ws[at] = f"own{i}x{at}"
        rows += [(2 * i, " ".join(ws)), (2 * i + 1, " ".join(ws[:-1] + [f"last{i}"]))]
    return rows


@pytest.mark.parametrize("small,tile", [(1024, 256), (16, 24)])
def test_large_buckets_are_searched_completely(spark, monkeypatch, small, tile):
    import pyarrow as pa

    from clusterlens.llm import words as W

    monkeypatch.setattr(oph_dups, "SMALL", small)
    if hasattr(oph_dups, "TILE"):
        monkeypatch.setattr(oph_dups, "TILE", tile)
    rows = spread_group(240)
    block = next(W.blocks(pa.array([t for _, t in rows])))
    bucket = oph_dups.Sketcher(4, bands=1, rows=1)(block)[3][:, 0]  # nearly all in one bucket
    assert max((bucket == b).sum() for b in bucket) > 100
    pairs = {(2 * i, 2 * i + 1) for i in range(120) if bucket[2 * i] == bucket[2 * i + 1]}
    _, _, comps = oph_dups.near_classes(spark.createDataFrame(rows, "id long, text string"), 4, 80, bands=1, rows=1)
    assert {(r.comp, r.node) for r in comps.collect() if r.comp != r.node} == pairs
    want = brute(rows, 4)
    assert all(want[a][1] == want[b][1] for a, b in pairs) and len({c for _, c in want.values()}) == 120
