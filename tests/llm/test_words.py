import random

import numpy as np
import pyarrow as pa
import pytest

from clusterlens.llm import words as W

TEXTS = ["a b  c", None, "", " x\n\ty ", "Éa b\x1fc d", "abc", "abc def ghi jkl", "q" * 50 + "\n", "\n\n", "Foo BAR foo bar"]


@pytest.mark.parametrize("limit", [1, 8, 1000])
def test_words_and_lines(limit):
    words, lines = [[] for _ in TEXTS], [[] for _ in TEXTS]
    for b in W.blocks(pa.array(TEXTS), limit):
        for out, spans in ((words, W.words(b)), (lines, W.lines(b))):
            for s, e, r in zip(*spans):
                out[r + b.first].append(b.data[s:e].tobytes())
    assert words == [(t or "").encode().split() for t in TEXTS]
    assert lines == [(t or "").encode().split(b"\n") for t in TEXTS]


def test_hash_depends_on_bytes_only(monkeypatch):
    monkeypatch.setattr(W, "_PIECE", 64)
    rng = random.Random(3)
    vocab = ["a", "b", "ab", "Ab", "é" * 3, "x" * 100, "y" * 63, "y" * 64, "y" * 65]
    text = " ".join(rng.choice(vocab) for _ in range(2000))
    for lower in (False, True):
        seen = {}
        for b in W.blocks(pa.array([text, None, text[7:]])):
            s, e, _ = W.words(b)
            for w, h in zip((b.data[i:j].tobytes() for i, j in zip(s, e)), W.SpanHash(5, lower)(b.data, s, e)):
                w = w.translate(W.LOWER_BYTES) if lower else w
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_shingle_sets():
    hasher = W.SpanHash(1, lower=True)
    rows = ["a b c d", "A B C D", "a b c d a b c d", "a b", "b a", "", None, "a b c"]
    sets = [[] for _ in rows]
    for b in W.blocks(pa.array(rows), 9):
        h, r = W.shingle_sets(b, hasher, 4)
        for x, k in zip(h, r):
            sets[k + b.first].append(int(x))
    assert [len(s) for s in sets] == [1, 1, 4, 1, 1, 0, 0, 1]
    assert sets[0] == sets[1] and set(sets[0]) < set(sets[2]) and len({tuple(sets[k]) for k in (0, 3, 4, 7)}) == 4
    assert all(s == sorted(s) for s in sets)


def test_sliced_column():
    column = pa.array(TEXTS).slice(3, 4)
    got = [b.data[s:e].tobytes() for b in W.blocks(column) for s, e, _ in zip(*W.words(b))]
    assert got == [w for t in TEXTS[3:7] for w in t.encode().split()]
    assert np.concatenate([W.words(b)[2] + b.first for b in W.blocks(column, 4)]).tolist() == [0, 0, 1, 1, 1, 2, 3, 3, 3, 3]
