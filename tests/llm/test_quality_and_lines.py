import hashlib
import re
from collections import Counter, defaultdict

import pytest

from clusterlens.llm import line_runs, rule_ledger

LONG = "the same quite long line of text"
ROWS = [(1, None), (2, ""), (3, "  \n\t"), (4, "one two three"), (5, "a b c d e " * 4), (6, "w%d " * 3 + "#$ &"),
        (7, f"x\n{LONG}\nz"), (8, f"{LONG.upper()}  \nQ\n{LONG}"), (9, f" {LONG}\n{LONG}\n"), (9, f" {LONG}\n{LONG}\n"),
        (10, "word " * 5000), (11, "\n".join(["alpha beta"] * 9)), (None, LONG), (12, "short\nshort"),
        (13, "É" * 19), (14, "É" * 20), (15, " " + "É" * 20), (16, "É" * 20 + "\t"), (17, "é" * 20),
        (18, " ".join(f"w{i}" for i in range(300)))]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    n = Counter(wins)
    hit = {p for i, w in enumerate(wins) if n[w] > 1 for p in range(i, i + 5)}
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(lines))


def test_measures(documents):
    got = rule_ledger.measured(documents(ROWS)).select("doc_id", "text", *rule_ledger.MEASURES).collect()
    assert Counter((r[0], *r[2:]) for r in got) == Counter((d, *brute_measures(t)) for d, t in ROWS)


def test_ledger_policies_and_ablation(documents):
    led = rule_ledger.ledger(documents(ROWS)).cache()
    rules = {r.name: r.bit for r in rule_ledger.RULES}
    rows = [r.failures for r in led.collect()]
    for r in led.collect():
        n = brute_measures(r.text)
        assert bool(r.failures & 1) == (n[0] < 10) and bool(r.failures & 2) == (100 * n[4] > 20 * n[0])
    got = {(r.policy, r.rule): r for r in rule_ledger.ablation(led, (rule_ledger.BASE, rule_ledger.STANDARD)).collect()}
    for p in (rule_ledger.BASE, rule_ledger.STANDARD):
        mask = p.mask(rule_ledger.RULES)
        for name in p.rules:
            bit = 1 << rules[name]
            r = got[p.name, name]
            assert (r.n_docs, r.n_failed, r.n_removed, r.n_only, r.n_kept_without) == (
                len(rows), sum(bool(x & bit) for x in rows), sum(bool(x & mask) for x in rows),
                sum(x & mask == bit for x in rows), sum(not x & mask & ~bit for x in rows))
    kept = rule_ledger.keep_passing(documents(ROWS))
    assert kept.columns == documents(ROWS).columns
    assert kept.count() == sum(not x & rule_ledger.STANDARD.mask(rule_ledger.RULES) for x in rows)


def key(line):
    k = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
    return re.sub("[A-Z]", lambda m: m[0].lower(), k)


def brute_lines(rows, min_docs=3):
    holds = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holds[key(x)].add(line_runs.NO_ID if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        d2 = line_runs.NO_ID if d is None else d
        keep = [x for x in lines if len(holds[key(x)]) < min_docs or max(holds[key(x)]) == d2]
        out.append((d, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (7, 3)])
def test_line_dedup(documents, batches, fanout):
    docs = documents(ROWS)
    out = line_runs.line_dedup(docs, batches=batches, fanout=fanout)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()]
    assert Counter(got) == Counter(brute_lines(ROWS))


def test_runs_compact_and_survive_a_cut_compaction(spark, documents):
    runs = line_runs.LineRuns(spark, fanout=2)
    parts = [documents([(10 * k + i, f"{LONG} {i % 3}\n{LONG} {k}") for i in range(3)], clash=False) for k in range(5)]
    keys = [line_runs.line_keys(p, p["doc_id"]) for p in parts]
    for k in keys:
        runs.add(k)
    assert runs.runs() == [(0, 3), (4, 4)]
    want = {tuple(r) for r in runs.entries().collect()}
    runs._write(keys[0].limit(0).selectExpr("h1", "h2", "1L n_docs", "doc last_doc", "1L salts"), (1, 2))  # stale
    assert runs.runs() == [(0, 3), (4, 4)] and {tuple(r) for r in runs.entries().collect()} == want
    counts = {r.n_docs for r in runs.entries().collect()}
    assert counts == {7, 3} and all(r.last_doc % 10 < 3 for r in runs.entries().collect())


def test_batch_form_drops_lines_of_earlier_batches(spark, documents):
    runs = line_runs.LineRuns(spark)
    first = line_runs.dedup_batch(documents([(1, f"{LONG} a\n{LONG} b")]), runs)
    again = line_runs.dedup_batch(documents([(2, f"{LONG} B\nnew\n{LONG} c"), (3, None)]), runs)
    third = line_runs.dedup_batch(documents([(4, f"{LONG} c\n{LONG} d")]), runs)
    assert [r.text for r in first.collect()] == [f"{LONG} a\n{LONG} b"]
    assert {r.doc_id: r.text for r in again.collect()} == {2: f"new\n{LONG} c", 3: ""}
    assert [(r.text, r.n_dropped) for r in third.collect()] == [(f"{LONG} d", 1)]


def test_empty_tables(documents):
    none = documents([(1, "x")]).where("false")
    assert rule_ledger.ledger(none).count() == 0 and rule_ledger.keep_passing(none).count() == 0
    assert line_runs.line_dedup(none).count() == 0
    assert rule_ledger.ablation(rule_ledger.ledger(none), (rule_ledger.BASE,)).count() == 0


def test_hash_of_kept_text(spark):
    rows = {r.doc_id: r for r in line_runs.op5_line_runs(spark, "/root/testdata/sf0.001").collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for d, text, n, gone in brute_lines(docs):
        assert (rows[d].n_lines, rows[d].n_dropped, rows[d].kept_sha256) == (n, gone, hashlib.sha256(text.encode()).hexdigest())
