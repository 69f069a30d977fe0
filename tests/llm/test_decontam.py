import re
import string
from collections import defaultdict

from clusterlens.llm import template_decontam as D

STORY = ("Yesterday morning Anna bought 5 apples and 9 pears for her sister Sue who lives 20 km away "
         "from the big city of Rome.")
ITEMS = [(1, STORY), (2, "the the"), (3, None), (4, ""), (5, "just six plain words in here"),
         (6, "one two three 4 5 6 7 8 9 10"), (7, " ".join(f"item{chr(97 + i)}" for i in range(26)))]


def brute_tokens(text):
    """(canonical, value) of each template token, by plain string handling."""
    raw, start = [], True
    for line in (text or "").split("\n"):
        start = True
        for w in re.findall(r"[^\x20\x09-\x0D]+", line):
            core = w.strip("".join(c for c in map(chr, range(128)) if not c.isalnum()))
            if core:
                raw.append((core, start))
                start = False
            start = start if not core else False
            if w[-1] in ".!?:":
                start = True
    out = []
    for k, (core, start) in enumerate(raw):
        low = core.lower()
        name = core[0].isupper() and not start and len(core) > 1 and not core[1].isupper()
        if name:
            kind = "<name>"
        elif core[0] in string.digits or low in D.NUMBER_WORDS:
            kind = "<num>"
        elif low in D.UNITS and out and out[-1][0] == "<num>" and not out[-1][2]:
            kind = "<unit>"
        else:
            kind = None
        if kind == "<name>" and out and out[-1][0] == "<name>" and raw[k - 1][0] and not raw[k][1] and out[-1][2] == "":
            out[-1] = ("<name>", out[-1][1] + " " + low, "")
            continue
        out.append((kind or low, low, ""))
    return [(c, v) for c, v, _ in out]


def brute(docs, items):
    out = {}
    for d, text in docs:
        toks = brute_tokens(text)
        for i, itext in items:
            it = brute_tokens(itext)
            size = min(D.WINDOW, len(it))
            lines = defaultdict(set)
            for p in range(len(it) - size + 1):
                canon = [c for c, _ in it[p:p + size]]
                if size < D.MIN_ITEM or sum(not c.startswith("<") for c in canon) < D.MIN_LITERALS:
                    continue
                for q in range(len(toks) - size + 1):
                    if [c for c, _ in toks[q:q + size]] == canon:
                        lines[q - p].add(p)
            cover, exact = {}, {}
            for shift, at in lines.items():
                pos = {x for p in at for x in range(p, p + size)}
                slots = {(it[x][1], toks[x + shift][1]) for x in pos if it[x][0].startswith("<")}
                if len({a for a, _ in slots}) < len(slots):
                    continue
                for x in pos:
                    cover[x] = cover.get(x, False) or all(a == b for a, b in slots)
            n = len(cover)
            if n and (n >= min(D.MIN_COVER, len(it)) or n >= D.WINDOW and 2 * n >= len(it)):
                out[d, i] = (len(it), n, all(cover.values()))
    return out


DOCS = [
    (1, "Well. " + STORY), (2, "Intro: " + STORY.replace("Anna", "Mary").replace("5", "7").replace("9 pears", "12 pears")),
    (3, STORY.lower()), (4, None), (5, ""), (6, "so just six plain words in here, you see"),
    (7, "yesterday morning Tom bought 5 apples and 9 pears"), (8, "no " * 4000),
    (9, " ".join(f"item{chr(97 + i)}" for i in range(9)) + " then other things follow at length here"),
    (10, " ".join(f"item{chr(97 + i)}" for i in range(13))), (11, " ".join(f"ITEM{chr(97 + i)}," for i in range(26))),
    (12, STORY + "\n" + STORY.replace("Rome", "Oslo")), (13, STORY.replace("Sue", "Eva Maria Sue")),
    (14, "Yesterday morning Anna bought five apples and nine pears for her sister Sue who lives thirty miles away"),
]


def test_matches_brute_force(spark, documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.id, r.item_id): (r.n_tokens, r.n_covered, r.exact) for r in D.contaminated(documents(DOCS), items).collect()}
    assert got == brute(DOCS, ITEMS)
    assert {(1, 1), (2, 1), (6, 5), (10, 7), (11, 7)} <= set(got) and not any(d in (4, 5, 7, 8, 9) for d, _ in got)


def test_slots_must_be_consistent(spark, documents):
    item = "Anna gave Ben a red ball and then Anna went back to see Ben about that very same red ball again"
    same = item.replace("Anna", "Zoe").replace("Ben", "Max")
    mixed = "Zoe gave Max a red ball and then Kim went back to see Lou about that very same red ball again"
    items = spark.createDataFrame([(1, "Once upon Anna " + item)], "item_id long, text string")
    docs = documents([(1, "Once upon Zoe " + same), (2, "Once upon Zoe " + mixed), (3, "Once upon Anna " + item)])
    got = {r.id: r.exact for r in D.contaminated(docs, items).collect()}
    assert got == {1: False, 3: True}


def test_missing_ids_and_empty_tables(spark, documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents([(None, STORY), (2, "clean"), (2, "clean"), (None, None)])
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns and [r.text for r in kept.collect()].count("clean") == 2 and kept.count() == 3
    assert D.decontaminate(docs.where("false"), items).count() == 0
    assert D.decontaminate(docs, items.where("false")).count() == 4


def test_benchmark_tables_equal_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): (r.n_tokens, r.n_covered, r.exact) for r in D.op3_template_decontam(spark, d).collect()}
    assert got == brute(docs, items)


def test_verbatim_copies_match_whatever_the_item_holds(spark, documents):
    texts = ["What is 12 + 34 - 5", "7 8 9 10 11 12 13 14 15", "What is the capital of France", "Paris",
             "Did Anna meet Ben or Carl or Dora or Emil in Rome or Oslo"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = documents([(0, "so 12 + 34: What is 12 + 34 - 5"), (1, "Numbers: 7 8 9 10 11 12 13 14 15, then 16"),
                      (2, "the question What is the capital of France was"), (3, "paris."), (4, texts[4].lower()),
                      (5, "7 8 9 10 11 12 13 14 99"), (6, "In Paris again"), (7, "What is 12 + 34 - 6")])
    got = {(r.id, r.item_id) for r in D.contaminated(docs, items).collect()}
    assert got - {(5, 1)} == {(i, i) for i in range(5)}  # 8 of 9 numbers are half of item 1 and more
    assert {r.id for r in D.literal_only(items).collect()} == {0, 1, 3}


def test_one_conflicting_value_drops_its_windows_only(spark, documents):
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(9)]
    item = " ".join(words[:10] + ["5"] + words[10:50] + ["5"] + words[50:])
    new = " ".join(words[:10] + ["5"] + words[10:50] + ["6"] + words[50:])  # one digit edited
    both = " ".join(words[:10] + ["7"] + words[10:50] + ["6"] + words[50:])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.id: (r.n_tokens, r.n_covered, r.exact) for r in D.contaminated(documents([(1, new), (2, both), (3, item)]), items).collect()}
    assert got == {1: (92, 91, False), 2: (92, 90, False), 3: (92, 92, True)}
