import base64
import gzip
import hashlib
import html
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import pytest

from clusterlens.llm import path_templates as U
from clusterlens.llm import style_tree as S
from clusterlens.llm import warc_derive as A
from clusterlens.llm.markup import text_blocks

DIR = "/root/testdata/sf0.001"


class Plain(HTMLParser):
    """Text blocks of the article, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.inside = [""], False

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        self.blocks += [] if tag in ("b", "br") else [""]
        self.blocks[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        self.blocks += [] if tag == "b" else [""]

    def handle_data(self, data):
        self.blocks[-1] += data if self.inside else ""


def test_main_text_equals_a_plain_parser(spark):
    want = {}
    for r in spark.read.parquet(f"{DIR}/pages.parquet").collect():
        p = Plain()
        p.feed(r.html or "")
        want[r.page_id] = "\n\n".join(t for t in (" ".join(b.split()) for b in p.blocks) if t)
    got = {r.page_id: (r.text, r.n_chars) for r in S.op10_style_tree(spark, DIR).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


@pytest.mark.parametrize("page,text", [
    ("<article><h1>T &amp; x</h1>a<p>b <a href='x>y'>c</a><script>if(a<b){}</script> d", "T & x\n\na\n\nb c\n\nd"),
    ("<nav>n</nav><div class='cookie-notice'>c</div><p>one<p>two<br>three", "one\n\ntwo three"),
    ("<main><p>m</p><aside>s</aside><div id=comments><p>r</p></div></main>x", "m"),
    ("<article>a<section class='sideBar'>b</section><form>f<p>g</form><p hidden>h</p>z</article>", "a\n\nz"),
    ("<ul><li>1<li>2</ul><style>p{}</style>&lt;p&gt; &#233;&nbsp;x", "1\n\n2\n\n<p> é x"),
    ("", ""), ("plain", "plain"), ("<", "<"), ("<p", "<p"), ("a <b c", "a <b c"), ("<!-- x", ""), ("<script>x", ""),
    ("</p></div>t<p/>u", "t\n\nu"), ("<div title=\"unclosed>t<p>u", "t\n\nu"),
])
def test_markup(page, text):
    assert S.main_text(text_blocks(page), frozenset()) == text


@pytest.mark.parametrize("page,text", [
    ("<article><h2 id='related-work'>Related work</h2><p>Body</p><h2 id='form-and-function'>Form</h2>"
     "<p class='notice-period'>..</p><p>x</p></article>", "Related work\n\nBody\n\nForm\n\n..\n\nx"),
    ("<article><p>a <math><mi>x</mi></math> b</p></article>", "a x b"),
    ("<p>intro</p><article class='teaser'><p>t</p></article><div class='content'><p>long main body</p></div>",
     "intro\n\nt\n\nlong main body"),
    ("<article><p>b</p><div class='comments'>c</div><ul class='share'><li>d</ul></article><div class='ad-box'>e</div>", "b"),
    ("<main>m<article>a long article</article></main><p>x", "a long article"), ("x<!-- y > z", "x"), ("x <!-- y", "x")])
def test_article_text_is_kept(page, text):
    assert S.main_text(text_blocks(page), frozenset()) == text


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>" * 50_000, "<script>" + "</script " * 100_000,
                                  "<a '" * 100_000 + ">", "<a \"'>" * 100_000, "<li>x" * 100_000])
def test_hostile_pages_take_one_pass(page):
    began = time.process_time()
    S.main_text(text_blocks(page), frozenset())
    assert time.process_time() - began < 10


def test_shared_headings_of_articles_stay(spark):
    rows = [(i, f"http://a.org/{i}", f"<body><div>Site of things</div><article><h2>Method</h2><p>Body {i} of the page</p>"
                                     f"<div class='box'>Read more</div></article></body>") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    low = S.low_branches(pages.select("html", S.host_of(S.F.col("url")).alias("host"))).first().low
    assert len(low) >= 2  # the branch above the article and the box: without them the text is another
    texts = {r.page_id: r.text for r in S.extracted(pages).collect()}
    assert texts[3] == "Method\n\nBody 3 of the page"
    assert S.main_text(text_blocks(rows[3][2]), frozenset()) == "Method\n\nBody 3 of the page\n\nRead more"


def test_style_tree_removes_branches_that_repeat(spark):
    def page(i, own=None):
        return (f"<body><div class='top x{i}'>Site of things</div><article><h1>Title {own or i}</h1><p>Body {own or i}</p>"
                f"<div class='box'>Read more on our site</div></article></body>")

    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(30)]
    rows += [(100 + i, f"http://copies.org/{i}", page(i, "same")) for i in range(30)]
    rows += [(200 + i, f"http://small.org/{i}", page(i)) for i in range(3)]
    rows += [(300, None, None), (301, "http://a.org/x", ""), (302, None, "<p>only"), (302, None, "<p>only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", S.F.lit(1)).withColumn("low", S.F.lit(2))
    out = S.extracted(pages)
    assert out.columns == ["page_id", "url", "row", "low", "text"]
    got = {r.page_id: r.text for r in out.collect()}
    assert got[3] == "Title 3\n\nBody 3"
    assert got[103] == "Title same\n\nBody same\n\nRead more on our site"  # a host of copies loses nothing
    assert got[201] == "Title 1\n\nBody 1\n\nRead more on our site"  # too few pages to judge
    assert (got[300], got[301], got[302], out.count()) == ("", "", "only", len(rows))
    assert S.extracted(pages.where("false")).count() == 0


# --- URL filter ----------------------------------------------------------------------------


def brute_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r, _ in U.RULES for h, _, p in [r.partition("/")]
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fits, key=len, default=None)


def test_rules_and_parts(spark):
    urls = ["http://WWW.Example.COM/en/x?y#z", "https://blog.example.com/en/1", "http://example.com/de", "http://xcom/en/",
            "http://a.net/es/", "http://a.net/es", "ftp://net/fr/1", None, "", "no scheme", "x://", "x://h?q/y", "x://h#f",
            "a://b://c/d", "http://É.COM/\nnew", "http://com", "http://example.com/en/" + "a/" * 500]
    rows = [(i, u, None if i % 3 else bool(i % 2)) for i, u in enumerate(urls)] + [(None, None, None), (0, urls[0], None)]
    got = U.judged(spark.createDataFrame(rows, "id long, url string, bad boolean")).collect()
    assert Counter((r.id, r.host, r.path, r.rule) for r in got) == Counter((i, *brute_rule(u)) for i, u, _ in rows)
    for r in got:
        assert r.rule is None or r.verdict == dict(U.RULES)[r.rule]


def test_tree_generalises_merges_and_rejects(spark):
    rows = []
    for i in range(60):  # slugs: a wide level; two sections that differ in quality
        rows.append((len(rows), f"http://s.org/good/slug-{i}", False))
        rows.append((len(rows), f"http://s.org/spam/deal-{i}", True))
        rows.append((len(rows), f"http://s.org/also/{i}.html", False))
    rows.append((len(rows), "http://s.org/spam/unseen", None))
    rows.append((len(rows), "http://other.org/2020-01-31/0123456789abcdef.html", None))
    got = {r.id: r for r in U.judged(spark.createDataFrame(rows, "id long, url string, bad boolean")).collect()}
    assert got[0].template == "/*/*" and got[2].template == "/*/{num}.html" or got[0].template.startswith("/")
    assert got[0].verdict == "allow" and got[1].verdict == "block" and got[2].verdict == "allow"
    assert got[len(rows) - 2].verdict == "block" and got[len(rows) - 2].template == got[1].template
    assert got[len(rows) - 1].template == "/{date}/{hex}.html"
    assert U.judged(spark.createDataFrame([], "id long, url string, bad boolean")).count() == 0


def test_a_hot_path_does_not_stop_its_siblings(spark):
    urls = [(f"http://s.org/x/slug{chr(97 + i // 26)}{chr(97 + i % 26)}", i % 5 < 3) for i in range(200)]
    urls += [("http://s.org/x/hot", False)] * 1000
    urls += [(f"http://u.org/user/n{chr(97 + i // 26)}{chr(97 + i % 26)}/post/p{i}x", i % 2 == 0) for i in range(60)]
    rows = [(i, u, b) for i, (u, b) in enumerate(urls)]
    got = {r.url: r for r in U.judged(spark.createDataFrame(rows, "id long, url string, bad boolean")).collect()}
    assert {(r.template, r.verdict) for u, r in got.items() if "slug" in u} == {("/x/*", "block")}
    assert got["http://s.org/x/hot"].verdict == "allow" and got["http://s.org/x/hot"].template == "/x/hot"
    assert {r.template for u, r in got.items() if "u.org" in u} == {"/user/*/post/*"}


def test_url_query_equals_rules(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet").collect()
    got = U.op2_path_templates(spark, DIR).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == Counter((p.page_id, *brute_rule(p.url)) for p in pages)


def brute_templates(urls):
    """{(host, segments): (template, n_labelled, n_bad, bad_rate)} by plain loops."""
    def segs(path):
        parts = path.removeprefix("/").split("/")
        closed = len(parts) > 1 and parts[-1] == ""
        out = []
        for x in parts[:-1] if closed else parts:
            for shape, name in U._SHAPES:
                if m := re.search(shape, x):
                    x = name + (m[1] or "" if m.groups() else "")
                    break
            out.append(x)
        return tuple(out[:-1] + [out[-1] + "/"]) if closed else tuple(out)

    stats = {}
    for host, path, bad in urls:
        s = stats.setdefault((host, segs(path)), [0, 0, 0])
        s[0] += 1
        s[1] += bad is not None
        s[2] += bad is True
    now = {k: list(k[1]) for k in stats}
    deepest = max(len(k[1]) for k in stats)

    def children(level):
        kids = {}
        for k, cur in now.items():
            if len(cur) > level:
                c = kids.setdefault((k[0], *cur[:level]), {}).setdefault(cur[level], [[], 0, 0, 0])
                c[0].append(k)
                for i in range(3):
                    c[i + 1] += stats[k][i]
        return kids

    for level in range(deepest):
        for kids in children(level).values():
            for keys, n, _, _ in kids.values():
                if len(kids) >= U.MIN_CHILDREN and n < U.VISITS:
                    for k in keys:
                        now[k][level] = "*"
    for level in reversed(range(deepest)):
        for kids in children(level).values():
            na, ba = (sum(c[i] for c in kids.values()) for i in (2, 3))
            for keys, _, n, b in kids.values():
                below = n * (na - n) * ba * (na - ba)
                if len(kids) > 1 and (below == 0 or (b * (na - n) - (ba - b) * n) ** 2 * na / below < U.SIMILAR):
                    for k in keys:
                        now[k][level] = "*"
    leaf = {}
    for k, cur in now.items():
        t = leaf.setdefault((k[0], "/" + "/".join(cur)), [0, 0])
        t[0] += stats[k][1]
        t[1] += stats[k][2]
    lab, bad = (sum(s[i] for s in stats.values()) for i in (1, 2))
    prior = bad / lab if lab else 0.0
    out = []
    for host, path, _ in urls:
        t = "/" + "/".join(now[host, segs(path)])
        n, b = leaf[host, t]
        out.append((host, path, t, n, b, "block" if (b + U.SMOOTHING * prior) / (n + U.SMOOTHING) >= U.REJECT else "allow"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_equals_brute_force(spark, monkeypatch, seed):
    import random
    monkeypatch.setattr(U, "MIN_CHILDREN", 4)
    monkeypatch.setattr(U, "VISITS", 2)
    rng = random.Random(seed)
    urls = []
    for _ in range(700):
        host = rng.choice(["a.org", "a.org", "a.org", "b.org", "c.d.org"])
        top = rng.choice(["blog", "shop", "forum", "x%d" % rng.randrange(60)])
        deep = [rng.choice(["a", "b", "2024-01-02", "%d.html" % rng.randrange(9), "s%d" % rng.randrange(90)])
                for _ in range(rng.choice([0, 1, 1, 2, 3]))]
        if rng.random() < 0.03:  # deep trees
            deep += ["p"] * 9 + ["q%d" % rng.randrange(12)]
        bad = rng.random() < {"forum": 0.9, "shop": 0.1}.get(top, 0.35)
        urls.append((host, "/" + "/".join([top, *deep]) + rng.choice(["", "", "/"]), rng.choice([bad, bad, None])))
    urls.append(("a.org", "/" + "/".join(["z"] * 400), None))  # one very deep path
    rows = [(i, f"http://{h}{p}", b) for i, (h, p, b) in enumerate(urls)]
    got = U.judged(spark.createDataFrame(rows, "id long, url string, bad boolean"), rules=()).collect()
    want = brute_templates(urls)
    assert sorted((r.host, r.path, r.template, r.n_labelled, r.n_bad, r.verdict) for r in got) == sorted(want)
    assert {r.verdict for r in got} == {"block", "allow"} and any("*" in r.template for r in got)


# --- WARC ----------------------------------------------------------------------------------


def test_records_round_trip_and_link(spark):
    page = "<head><title>t</title></head><body><p>x &amp; y<p>é" + "z" * 5000
    rows = [(1, None, None), (2, "http://a/b", page), (2, "http://a/b", page), (3, "http://a/\r\nEvil: 1", "<p>q"), (None, "u", "")]
    source = A.page_responses(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", A.F.lit(0)))
    records = A.derivatives(source).collect()
    data = {r.record_id: bytes(r.data) for r in A.serialised(A.derivatives(source)).collect()}
    assert len(records) == 2 * len(rows)
    sources = {r.record_id: r for r in source.collect()}
    for r in records:
        (headers, block), = A.parse_records(data[r.record_id])
        h = dict(headers)
        assert block == bytes(r.block) and headers == [(x.name, x.value) for x in r.headers]
        assert h["WARC-Refers-To"] == r.refers_to and r.refers_to in sources
        assert h["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        assert int(h["Content-Length"]) == len(block) == r.content_length
        body = bytes(sources[r.refers_to].block).partition(b"\r\n\r\n")[2]
        if r.record_type == "metadata":
            fields = dict(x.split(": ", 1) for x in block.decode().splitlines() if ": " in x)
            assert fields["refers-to"] == r.refers_to and fields["source-header-warc-type"] == "response"
            assert fields["source-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
            assert fields["http-status"].startswith("HTTP/1.1 200")
        elif r.source_id == 2:
            assert block.decode() == "x & y\n\né" + "z" * 5000
    joined = b"".join(data[r.record_id] for r in records)
    assert len(A.parse_records(joined)) == len(records)
    assert A.derivatives(source.where("false")).count() == 0


def _chunked(data, size=7):
    parts = [data[i:i + size] for i in range(0, len(data), size)]
    return b"".join(b"%x;x=1\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


PAGE = "<html><head><title>t</title></head><body><p>café au lait</p><p>two</p></body></html>"
RAW = zlib.compressobj(wbits=-15)
BODIES = [  # headers, body, text or the reason that there is none
    (["Content-Type: text/html; charset=ISO-8859-1"], PAGE.encode("latin-1"), "café au lait\n\ntwo"),
    (["Content-Type: text/html"], PAGE.replace("<title>", "<meta charset='windows-1252'><title>").encode("cp1252"), "café au lait\n\ntwo"),
    (["Content-Type: text/html; charset=no-such"], PAGE.encode(), "café au lait\n\ntwo"),
    (["Content-Type: text/html; charset=base64"], PAGE.encode(), "café au lait\n\ntwo"),
    (["Content-Type: text/html; charset=latin-1"], b"\xef\xbb\xbf" + PAGE.encode(), "café au lait\n\ntwo"),
    ([], PAGE.encode("utf-16"), "café au lait\n\ntwo"),
    (["Content-Encoding: gzip", "Content-Type: text/html"], gzip.compress(PAGE.encode()), "café au lait\n\ntwo"),
    (["Content-Encoding: gzip"], gzip.compress(PAGE[:50].encode()) + gzip.compress(PAGE[50:].encode()), "café au lait\n\ntwo"),
    (["content-encoding: deflate"], zlib.compress(PAGE.encode()), "café au lait\n\ntwo"),
    (["content-encoding: deflate"], RAW.compress(PAGE.encode()) + RAW.flush(), "café au lait\n\ntwo"),
    (["Transfer-Encoding: chunked", "Content-Encoding: gzip"], _chunked(gzip.compress(PAGE.encode())), "café au lait\n\ntwo"),
    (["Transfer-Encoding: chunked"], PAGE.encode(), "café au lait\n\ntwo"),
    (["Content-Encoding: deflate, gzip"], gzip.compress(zlib.compress(PAGE.encode())), "café au lait\n\ntwo"),
    (["Content-Type: text/plain"], b"a < b\n  <p>c", "a < b\n  <p>c"),
    (["Content-Encoding: gzip"], b"", ""),
    (["Content-Encoding: gzip"], b"not packed", None),
    (["Content-Encoding: br"], b"\x0b\x02", None),
    (["Content-Type: application/pdf"], b"%PDF-1.7 x", None),
    (["Content-Type: image/png"], b"\x89PNG", None),
    ([], b"%PDF-1.7 x", None),
    ([], b"abc\0def", None),
]


def test_bodies_of_any_encoding(spark):
    rows = [(i, f"r{i}", None, None, None, bytearray("\r\n".join(["HTTP/1.1 200 OK", *h]).encode() + b"\r\n\r\n" + body))
            for i, (h, body, _) in enumerate(BODIES)]
    schema = "id long, record_id string, target_uri string, date string, headers array<struct<name:string,value:string>>, block binary"
    records = A.derivatives(spark.createDataFrame(rows, schema)).collect()
    texts = {r.source_id: bytes(r.block).decode() for r in records if r.record_type == "conversion"}
    metas = {r.source_id: bytes(r.block).decode() for r in records if r.record_type == "metadata"}
    assert texts == {i: t for i, (_, _, t) in enumerate(BODIES) if t is not None}
    assert len(metas) == len(BODIES)
    for i, (_, body, t) in enumerate(BODIES):
        assert ("no-text-reason: " in metas[i]) == (t is None) and ("text-length: " in metas[i]) == (t is not None)
        assert "source-payload-digest: " + A.digest(body) in metas[i]


def test_a_body_that_breaks_off_or_grows_too_large():
    packed = gzip.compress(b"".join(b"%d " % i for i in range(20_000)))
    part = A.unpacked(packed[:len(packed) // 2], "gzip")
    assert part and b"".join(b"%d " % i for i in range(20_000)).startswith(part)
    with pytest.raises(A.NotText, match="unpacks"):
        A.unpacked(gzip.compress(b"a" * 5_000_000), "gzip", 1_000_000)


def test_conversion_text_of_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    for r in A.op1_warc_derive(spark, DIR).where("record_type = 'conversion'").collect():
        body = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->", "", pages[r.page_id])
        parts = re.split(r"</?(?:html|body|nav|ul|li|div|article|h1|p|footer|!DOCTYPE)\b[^>]*>", body.replace("<br>", " "))
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
        assert r.block == "\n\n".join(x for x in parts if x)
