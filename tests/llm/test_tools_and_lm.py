import json
import json
import math
import random
import re
from collections import Counter

import pytest

from clusterlens.llm import backoff_lm as B
from clusterlens.llm import tool_links as L

EVENTS = "conv_id long, pos long, kind string, call_id string, name string, arguments string, content string"


def brute_order(calls):
    """Levels by plain recursion; calls on or behind a cycle have none."""
    refs = {c: [r for r in rs if r in calls] for c, (_, rs) in calls.items()}
    level, state = {}, {}

    def visit(c):
        if state.get(c) == 1:
            return None
        if c in level:
            return level[c]
        state[c] = 1
        found = [visit(r) for r in refs[c]]
        state[c] = 2
        level[c] = None if None in found else 1 + max(found, default=-1)
        return level[c]

    for _ in range(2):  # a node first met inside a cycle is settled again
        for c in sorted(calls):
            if level.get(c, 0) is not None:
                level.pop(c, None)
                state.clear()
                visit(c)
    order = sorted(calls, key=lambda c: (math.inf if level[c] is None else level[c], calls[c][0], c))
    return {c: (level[c], order.index(c)) for c in calls}


def make_events(rng, conv, n, reach):
    rows, calls = [], {}
    for i in range(n):
        refs = sorted({f"c{rng.randrange(n + 2)}" for _ in range(rng.choice([0, 0, 1, 2]))} if reach == "any" else
                      {f"c{rng.randrange(i)}" for _ in range(rng.choice([0, 1, 2])) if i})
        args = {"query": "q", "context": {"list": [{"$ref": r} for r in refs]}}
        rows.append((conv, 10 * i, "call", f"c{i}", "search", json.dumps(args), None))
        calls[f"c{i}"] = (10 * i, refs)
        for k in range(rng.choice([0, 1, 1, 2])):
            rows.append((conv, 10 * i + 1 + k, "result", f"c{i}", None, None, f"r{i}.{k}"))
    rows.append((conv, 9999, "result", "nobody", None, None, "lost"))
    rng.shuffle(rows)
    return rows, calls


@pytest.mark.parametrize("reach,seed", [("back", 1), ("any", 2), ("any", 3)])
def test_links_and_order(spark, reach, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for conv in (1, 2, 3):
        r, calls = make_events(rng, conv, 40 if conv == 1 else 6, reach)
        rows += r
        order = brute_order(calls)
        for c, (pos, refs) in calls.items():
            results = sorted(x[1:] for x in r if x[2] == "result" and x[3] == c)
            want[conv, c] = ("linked" if results else "no_result", *order[c], results[0][5] if results else None,
                             len(results), sorted(x for x in refs if x not in calls))
    out = L.link_tool_calls(spark.createDataFrame(rows, EVENTS)).collect()
    got = {(r.conv_id, r.call_id): (r.status, r.level, r.order, r.content, r.n_results, r.missing_refs)
           for r in out if r.status != "orphan"}
    assert got == want
    assert Counter(r.call_id for r in out if r.status == "orphan") == {"nobody": 3}
    for r in out:
        if r.record:
            d = json.loads(r.record)
            assert r.record == json.dumps(d, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            assert (d["order"], d["result"], d["depends_on"]) == (r.order, r.content, r.refs)


@pytest.mark.parametrize("args,errors", [
    ('{"query":"x","limit":5}', []), ('{"limit":0}', ["arguments.query: missing", "arguments.limit: below minimum"]),
    ('{"query":"","limit":1.5}', ["arguments.limit: not an integer", "arguments.query: too short"]),
    ('{"query":"x","limit":5.0,"z":1}', ["arguments.z: not allowed"]), ("[1]", ["arguments: not an object"]),
    ("{", ["arguments: not an object"]), (None, ["arguments: not an object"]), ('{"query":{"$ref":"c0"}}', []),
    ('{"query":true}', ["arguments.query: not a string"])])
def test_validation(spark, args, errors):
    out = L.link_tool_calls(spark.createDataFrame([(1, 1, "call", "a", "search", args, None)], EVENTS)).first()
    assert out.errors == errors


HUGE = "1" + "0" * 400


@pytest.mark.parametrize("args,errors,kept", [
    ('{"query":"x","limit":%s}' % HUGE, ["arguments.limit: above maximum"], '{"limit":%s,"query":"x"}' % HUGE),
    ('{"query":"x","limit":1%s}' % ("0" * 5000), ["arguments: a number out of range", "arguments.limit: not an integer"],
     '{"limit":null,"query":"x"}'),
    ('{"query":"x","limit":1e999}', ["arguments: a number out of range", "arguments.limit: not an integer"],
     '{"limit":null,"query":"x"}'),
    (r'{"query":"\ud800"}', [], r'{"query":"\ud800"}'), (r'{"query":"\ud83d\ude00"}', [], '{"query":"\U0001F600"}'),
    (r'{"query":"x","\udc00":1}', [r"arguments.\udc00: not allowed"], r'{"query":"x","\udc00":1}'),
    ('{"query":"x","query":"y"}', ["arguments: key query repeated"], '{"query":"y"}'),
    ('{"query":"x","limit":NaN}', ["arguments: not an object"], None),
    ('{"query":"[[[{","context":%s1%s}' % ('{"a":' * 150, "}" * 150), [],
     '{"context":%s1%s,"query":"[[[{"}' % ('{"a":' * 150, "}" * 150)),
    *[(deep, [L.TOO_DEEP], deep) for n in (600, 5000, 200_000) for deep in ('{"query":"x","context":%s1%s}' % ('{"a":' * n, "}" * n),)],
    ("[" * 100_000, [L.TOO_DEEP], "[" * 100_000)])
def test_legal_but_odd_arguments(spark, args, errors, kept):
    out = L.link_tool_calls(spark.createDataFrame([(1, 1, "call", "a", "search", args, None)], EVENTS)).first()
    assert (out.errors, out.arguments) == (errors, kept)
    assert json.loads(out.record)["call_id"] == "a"


def test_canonical_json():
    assert L.canonical({"b": 1.0, "a": [1e2, -0.0, 2.5, True, None, "é"], "c": {"z": 1, "y": 2}}) == \
        '{"a":[100,0,2.5,true,null,"é"],"b":1,"c":{"y":2,"z":1}}'


def test_odd_events(spark):
    rows = [(None, None, "call", None, "search", '{"query":"x"}', None), (1, 5, "call", "a", "nope", "{}", None),
            (1, 5, "call", "a", "nope", "{}", None), (1, 7, "result", "a", None, None, ""), (1, 8, "result", None, None, None, "o"),
            (1, 3, "call", "s", "search", '{"query":{"$ref":"s"}}', None), (2, 1, "other", "a", None, None, None)]
    df = spark.createDataFrame(rows, EVENTS).withColumn("key", L.F.lit("own")).withColumn("refs", L.F.lit("own"))
    out = {(r.conv_id, r.call_id): r for r in L.link_tool_calls(df).collect()}
    assert set(out) == {(None, ""), (1, "a"), (1, "s"), (1, "")}
    assert out[None, ""].status == "no_result" and out[1, ""].status == "orphan"
    assert (out[1, "a"].errors, out[1, "a"].n_calls, out[1, "a"].content, out[1, "a"].order) == (["unknown tool"], 2, "", 0)
    assert out[1, "s"].level is None and out[1, "s"].order == 1
    assert L.link_tool_calls(df.where("false")).count() == 0


def test_derived_events_cover_the_table(spark):
    d = "/root/testdata/sf0.001"
    conv = spark.read.parquet(f"{d}/conversations.parquet").collect()
    calls = {(r.conv_id, f"c{r.turn}_{i}"): x for r in conv if r.role == "assistant"
             for i, x in enumerate(x for x in r.text.split("\n") if x.strip())}
    results = {(r.conv_id, f"c{r.turn - 1}_{i}"): x for r in conv if r.role != "assistant" and r.turn
               for i, x in enumerate(x for x in r.text.split("\n") if x.strip())}
    out = L.op4_tool_links(spark, d).collect()
    assert {(r.conv_id, r.call_id): r.content for r in out if r.status != "orphan"} == {k: results.get(k) for k in calls}
    assert {(r.conv_id, r.call_id) for r in out if r.status == "orphan"} == set(results) - set(calls)
    for r in out:
        assert r.level is not None or r.status == "orphan"


def brute_scores(rows):
    low = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    toks = [(d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low))) for d, t in rows]
    one, two = Counter(), Counter()
    for _, w in toks:
        one.update(w)
        two.update(zip(w, w[1:]))
    total, out = sum(one.values()), {}
    for d, w in toks:
        own, s, found = Counter(zip(w, w[1:])), 0.0, 0
        for i, x in enumerate(w):
            k = two[w[i - 1], x] - own[w[i - 1], x] if i else 0
            found += k > 0
            s += math.log(k / one[w[i - 1]]) if k > 0 else math.log((B.ALPHA if i else 1) * one[x] / total)
        n0, f0, s0 = out.get(d, (0, 0, 0.0))
        out[d] = (n0 + len(w), f0 + found, s0 + s)
    return out


@pytest.mark.parametrize("hot_words,hot_pairs,bucket", [(1 << 19, 1 << 17, 2_000_000), (50, 60, 500), (1, 1, 50)])
def test_scores_equal_brute_force(documents, monkeypatch, hot_words, hot_pairs, bucket):
    monkeypatch.setattr(B, "HOT_WORDS", hot_words)
    monkeypatch.setattr(B, "HOT_PAIRS", hot_pairs)
    rng = random.Random(4)
    vocab = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(400)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 5, 80]))) + " the OF the of" * rng.choice([0, 9])) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "unheard"), (503, "the of"), (504, "of the " * 3000)]
    got = {r.id: r for r in B.backoff_scores(documents(rows), bucket_words=bucket).collect()}
    for d, (n, found, s) in brute_scores(rows).items():
        assert (got[d].n_words, got[d].n_found) == (n, found)
        assert got[d].log_score == pytest.approx(s, rel=1e-9) if n else got[d].log_score is None
    assert len(got) == len(rows)


def test_repeated_rows_score_alike_in_any_partitioning(documents):
    rows = [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (2, "x y"), (1, "beta gamma"), (3, "alpha beta alpha beta")]
    want = {d: (n, found, pytest.approx(s)) for d, (n, found, s) in brute_scores(rows).items()}
    for parts in (1, 3, 5):
        got = B.backoff_scores(documents(rows).repartition(parts)).collect()
        assert {r.id: (r.n_words, r.n_found, r.log_score) for r in got} == want


def test_scores_of_missing_ids_and_empty_table(documents):
    docs = documents([(None, "a b"), (None, "a b"), (7, "a b c")])
    got = B.backoff_scores(docs).collect()
    assert len(got) == 2 and {r.n_words for r in got} == {4, 3}
    assert B.backoff_scores(docs.where("false")).count() == 0


def test_a_block_sends_each_bigram_once(spark, documents):
    text = " ".join(f"w{i % 50} x{i % 7}" for i in range(400))
    rows = documents([(i, text) for i in range(60)]).selectExpr("cast(doc_id % 2 AS int) AS block", "doc_id AS doc", "text")
    lists = B._block_counts(rows, 3).collect()
    assert sorted((r.block, r.part) for r in lists) == [(b, p) for b in (0, 1) for p in range(3)]
    words = text.split()
    distinct = len(set(words)) + len(set(zip(words, words[1:]))) + 1
    for block in (0, 1):
        keys = [k for r in sorted(lists, key=lambda r: r.part) if r.block == block for k in r.keys]
        assert len(keys) == len(set(keys)) == distinct  # not one for each of the 30 copies
        assert sum(c for r in lists if r.block == block for c in r.counts) == 30 * (3 * len(words) - 1)


def test_texts_are_shuffled_once(documents):
    out = B.backoff_scores(documents([(i, f"a b c {i}") for i in range(40)]), bucket_words=20)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and "hashpartitioning(v" not in plan
