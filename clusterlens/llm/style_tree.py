"""Operator 10: main-text extraction with a style tree per site.

The pages of a host are merged into one tree: a node is the path of
presentations (tag and class words) from the root. For each node the tree
counts, over the host's pages, the different presentations of its children and
the different texts below it. Importance is the entropy of these
distributions, scaled to 0 .. 1 by the number of occurrences, GAMMA for content
and 1 - GAMMA for presentation: a branch that looks and reads the same on every
page has 0. Nodes whose presentation names a page part (menu, advert, form, ...)
have importance 0 by that name, ``article`` and ``main`` have 1.

From each page the branches below LOW are removed. Only nodes seen often
enough (MIN_SEEN times, on SHARE of the host's pages) can be judged by entropy,
and inside the article only where the article itself varies (KEEP), so that a
host full of copies loses nothing. What is left is the text of the page's
``article`` (else ``main``) if that is at least half of it, otherwise all that is left.

Scale: one scan makes (node, features) rows, combined map-side; the list of a
host's low nodes is bounded by the page size (each is on SHARE of its pages)
and joined to the pages by host and salt; a second scan extracts.

Defined results: null or empty html gives an empty text; unclosed or broken
markup is read as far as it goes; pages without host share the empty host;
repeated rows are pages of their own; an empty table gives an empty table;
further columns pass through unless named like an added one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm import shared
from clusterlens.llm.markup import CONTAINERS, Block, text_blocks
from clusterlens.llm.path_templates import host_of
from clusterlens.sources.tables import table

GAMMA = 0.9
LOW = 0.2
KEEP = 0.5
MIN_SEEN = 10
SHARE = 0.2


def _h(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(),
                          "big", signed=True)


def node_keys(path: tuple) -> Iterator[int]:
    """The key of each node of a path: a hash of its parent's key and its presentation."""
    key = 0
    for e in path:
        key = _h(str(key), e.sign)
        yield key


def _nodes(blocks: list[Block]) -> dict[int, list]:
    """Each node of a page: whether it lies in the article, and hashes of the
    presentations and of the texts below it, in page order."""
    out: dict[int, list] = {}
    for b in blocks:
        main, text = False, b.text.encode("utf-8", "surrogatepass") + b"\x1f"
        for d, key in enumerate(node_keys(b.path), 1):
            main = main or b.path[d - 1].role == "main"
            node = out.get(key)
            if node is None:
                node = out[key] = [main, None, hashlib.blake2b(digest_size=8), hashlib.blake2b(digest_size=8)]
            below = b.path[d].sign if d < len(b.path) else "#text"
            if node[1] != below:
                node[1] = below
                node[2].update(below.encode("utf-8", "surrogatepass") + b"\x1f")
            node[3].update(text)
    return out


_TREE = "host string, node long, main boolean, look long, words long"


def style_nodes(pages: DataFrame) -> DataFrame:
    """(host, node, main, look, words): a row for each node of each page of
    ``pages`` (host, html), with hashes of its presentation and its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for key, (main, _, looks, texts) in _nodes(text_blocks(page.as_py() or "")).items():
                    rows.append((host, key, main, *(int.from_bytes(h.digest(), "big", signed=True) for h in (looks, texts))))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)],
                                             names=["host", "node", "main", "look", "words"])

    return pages.select("host", "html").mapInArrow(run, _TREE)


def importance(nodes: DataFrame) -> DataFrame:
    """(host, node, main, seen, importance) of every node of the style tree."""

    def entropy(feature: str) -> DataFrame:
        each = nodes.groupBy("host", "node", feature).agg(F.count(F.lit(1)).alias("c"), F.max("main").alias("main"))
        whole = each.groupBy("host", "node").agg(F.sum("c").alias("seen"), F.max("main").alias("main"),
                                                 F.sum(F.col("c") * F.log("c")).alias("s"))
        scaled = F.when(F.col("seen") > 1, 1 - F.col("s") / (F.col("seen") * F.log("seen"))).otherwise(1.0)
        return whole.select("host", "node", "main", "seen", scaled.alias(feature))

    both = entropy("words").join(entropy("look").select("host", "node", "look"), ["host", "node"])
    return both.select("host", "node", "main", "seen",
                       (GAMMA * F.col("words") + (1 - GAMMA) * F.col("look")).alias("importance"))


def low_branches(pages: DataFrame) -> DataFrame:
    """(host, low): the nodes of low importance of each host that has some."""
    nodes = shared.written(style_nodes(pages), "style-nodes")
    # root nodes are on every page with text
    tree = shared.written(importance(nodes), "style-tree")
    size = tree.groupBy("host").agg(F.max("seen").alias("pages"),
                                    F.max(F.when(F.col("main"), F.col("importance"))).alias("article"))
    low = tree.where((F.col("importance") < LOW) & (F.col("seen") >= MIN_SEEN)).join(size, "host")
    low = low.where((F.col("seen") >= SHARE * F.col("pages")) & (~F.col("main") | (F.col("article") >= KEEP)))
    return low.groupBy("host").agg(F.collect_set("node").alias("low"))


def main_text(blocks: list[Block], low: frozenset[int]) -> str:
    """The text left when the low branches are gone: of the ``article``, else of
    ``main``, if that is at least half of what is left (a teaser is not), else
    all of it. Inside the article low containers go, but no heading,
    paragraph, list item or cell: what articles of a site share is their text."""
    kept: list[tuple[int, str]] = []
    for b in blocks:
        rank = 0
        for e, key in zip(b.path, node_keys(b.path) if low else b.path, strict=True):
            if e.role == "boiler":
                break
            judged = e.tag in CONTAINERS if rank else e.tag not in ("html", "body") and e.role != "main"
            if low and judged and key in low:
                break
            if e.role == "main":
                rank = max(rank, 2 if e.tag == "article" else 1)
        else:
            kept.append((rank, b.text))
    size = sum(len(t) for _, t in kept)
    for best in (2, 1):
        own = [t for r, t in kept if r >= best]
        if own and 2 * sum(map(len, own)) >= size:
            return "\n\n".join(own)
    return "\n\n".join(t for _, t in kept)


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text, in place of the html."""
    pages = shared.without(pages, "text", "_host", "_row")
    rest = [c for c in pages.columns if c != page]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(f"`{page}`").alias("html"),
                        host_of(F.col(f"`{url}`")).alias("host"),
                        F.xxhash64(F.col(f"`{page_id}`"), F.col(f"`{url}`")).alias("rid"))
    rows = shared.lookup(rows, "host", low_branches(rows), "rid").select("row", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(text_blocks(p.as_py() or ""), frozenset(low.as_py() or ()))
                     for p, low in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    schema = rows.select("row", F.lit("").alias("text")).schema
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"row.`{c}`") for c in rest], "text")


def op10_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every ``pages`` row."""
    out = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
