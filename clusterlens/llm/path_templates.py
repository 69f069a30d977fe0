"""Operator 2: URL filter from a path-template tree per host.

1. A URL's path is cut into segments; segments of a typed shape (number, date,
   UUID, long hexadecimal, each with its file extension) become a typed
   wildcard at once. A trailing slash belongs to the last segment.
2. *Generalise*: from the root down, below a (generalised) prefix of a host
   with MIN_CHILDREN or more different segments, those seen less than VISITS
   times become ``*``; frequent ones stay.
3. *Merge*: from the deepest level up, the branches below one prefix are
   compared by their labelled pages: a branch whose bad rate does not differ
   significantly (chi-square, 5 %) from its siblings' joins them as ``*``.
4. *Judge*: a template's bad rate is smoothed towards the rate of all labelled
   pages; at REJECT or more the template is blocked.

Rules (host suffix plus path prefix, longest first) come before the method.
All statistics are sums over distinct paths, combined map-side; tables are
joined back to pages, paths or branches with salts, since one host, prefix or
path may hold a third of all rows. The tree is worked off level by level, as deep
as any host has two different paths: deeper down a path is alone, and nothing
is there to generalise or merge, so one very deep URL costs no round.

Defined results: a null URL, or one without ``://``, has empty host and path;
an empty path is one empty segment; pages without label count for the shape
of the tree but not for its rates; with no labels at all nothing is blocked by
the method; repeated rows are judged each for itself and count each; an empty
table gives an empty table; further columns do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clusterlens.llm import shared
from clusterlens.sources.tables import table

MIN_CHILDREN = 20
VISITS = 3
SIMILAR = 3.841  # chi-square, one degree of freedom, 5 %
SMOOTHING = 5
REJECT = 0.5

# The rules of the contract, as (rule, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
         ("net/es/", "block"), ("net/fr/", "block"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# Typed shapes, tried in this order; the extension stays.
_SHAPES = ((r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(\.[a-z0-9]{1,5})?$", "{date}"),
           (r"^[0-9]+(\.[a-z0-9]{1,5})?$", "{num}"),
           (r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(\.[a-z0-9]{1,5})?$", "{uuid}"),
           (r"^[0-9a-f]{12,}(\.[a-z0-9]{1,5})?$", "{hex}"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null (ties: the last by text)."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _typed(seg: Column) -> Column:
    out = seg
    for shape, name in reversed(_SHAPES):
        out = F.when(seg.rlike(shape), F.concat(F.lit(name), F.regexp_extract(seg, shape, 1))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """Typed segments of a path; a trailing slash stays with the last one."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    last = F.element_at(parts, -1)
    closed = (last == "") & (F.size(parts) > 1)
    body = F.when(closed, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    typed = F.transform(body, _typed)
    n = F.size(body)
    return F.transform(typed, lambda s, i: F.when(closed & (i == n - 1), F.concat(s, F.lit("/"))).otherwise(s))


def _generalise_level(paths: DataFrame, depth: int) -> DataFrame:
    """Seldom seen segments at ``depth`` (1: first segment) as ``*``, below
    prefixes that are generalised already."""
    here = F.size("segs") >= depth
    parent = F.expr(f"xxhash64(host, array_join(slice(segs, 1, {depth - 1}), '/'))")
    keyed = paths.withColumn("parent", parent).withColumn(
        "branch", F.when(here, F.xxhash64("parent", F.element_at("segs", depth))))
    kids = keyed.where(here).groupBy("parent", "branch").agg(F.sum("n").alias("n"))
    wide = kids.groupBy("parent").agg(F.count(F.lit(1)).alias("kids")).where(F.col("kids") >= MIN_CHILDREN)
    rare = shared.lookup(kids.where(F.col("n") < VISITS), "parent", wide, "branch", "inner")
    out = shared.lookup(keyed, "branch", rare.select("branch", F.lit(True).alias("rare")), "pk")
    segs = F.transform("segs", lambda s, i: F.when(i == depth - 1, "*").otherwise(s))
    return out.select("pk", "host", F.when(F.col("rare"), segs).otherwise(F.col("segs")).alias("segs"), "n", "n_lab", "n_bad")


def _merge_level(paths: DataFrame, depth: int) -> DataFrame:
    """Merge similar branches at ``depth`` (1: first segment)."""
    here = F.size("segs") >= depth
    parent = F.expr(f"xxhash64(host, array_join(slice(segs, 1, {depth - 1}), '/'))")
    keyed = paths.withColumn("parent", parent).withColumn(
        "branch", F.when(here, F.xxhash64("parent", F.element_at("segs", depth))))
    branch = keyed.where(here).groupBy("parent", "branch").agg(F.sum("n_lab").alias("n"), F.sum("n_bad").alias("b"))
    level = branch.groupBy("parent").agg(F.sum("n").alias("na"), F.sum("b").alias("ba"), F.count(F.lit(1)).alias("kids"))
    level = shared.lookup(branch, "parent", level.where("kids > 1"), "branch", "inner")
    n, b, na, ba = (F.col(c).cast("double") for c in ("n", "b", "na", "ba"))
    below = n * (na - n) * ba * (na - ba)
    off = b * (na - n) - (ba - b) * n
    joins = F.when(below == 0, True).otherwise(off * off * na / below < SIMILAR)
    merged = level.where(joins).select("branch", F.lit(True).alias("joins"))
    out = shared.lookup(keyed, "branch", merged, "pk")
    segs = F.transform("segs", lambda s, i: F.when(F.col("joins") & (i == depth - 1), "*").otherwise(s))
    return out.select("pk", "host", F.when(F.col("joins"), segs).otherwise(F.col("segs")).alias("segs"), "n", "n_lab", "n_bad")


def shared_depth(paths: DataFrame) -> int:
    """The deepest level that two paths of one host reach (0: none): of each
    host, the greatest depth that is its own or passed by two paths or more."""
    depths = paths.groupBy("host", F.size("segs").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("host").orderBy(F.col("d").desc())  # one row per depth of a host
    reached = depths.withColumn("n", F.sum("n").over(down)).where("n > 1")
    return reached.agg(F.max("d")).first()[0] or 0


def judged(urls: DataFrame, rules=RULES) -> DataFrame:
    """``urls`` (id, url, bad) with host, path, rule, template, n_labelled,
    n_bad, bad_rate and verdict; bad is true, false or null (no label)."""
    rows = urls.select("id", "url", "bad", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("segs", segments(F.col("path")))
    rows = rows.withColumn("pk", F.xxhash64("host", F.array_join("segs", "/")))
    rows = rows.withColumn("rid", F.xxhash64("id", "url"))
    paths = rows.groupBy("pk").agg(
        F.first("host").alias("host"), F.first("segs").alias("segs"), F.count(F.lit(1)).alias("n"),
        F.count("bad").alias("n_lab"), F.coalesce(F.sum(F.col("bad").cast("bigint")), F.lit(0)).alias("n_bad"))
    paths = shared.written(paths, "paths")
    top = paths.agg(F.sum("n_lab").alias("n"), F.sum("n_bad").alias("b")).first()
    levels = shared_depth(paths)
    prior = (top["b"] or 0) / top["n"] if top["n"] else 0.0
    tree = paths
    for depth in range(1, levels + 1):
        tree = shared.written(_generalise_level(tree, depth), "generalised")
    for depth in range(levels, 0, -1):
        tree = shared.written(_merge_level(tree, depth), "merged")
    tree = tree.withColumn("template", F.concat(F.lit("/"), F.array_join("segs", "/")))
    tree = tree.withColumn("tk", F.xxhash64("host", "template"))
    leaf = tree.groupBy("tk").agg(F.sum("n_lab").alias("n_labelled"), F.sum("n_bad").alias("n_bad_all"))
    leaf = leaf.withColumn("bad_rate", (F.col("n_bad_all") + F.lit(float(SMOOTHING * prior)))
                           / (F.col("n_labelled") + F.lit(float(SMOOTHING))))
    found = shared.lookup(tree.select("pk", "tk", "template"), "tk", leaf, "pk", "inner")
    found = found.select("pk", "template", "n_labelled", F.col("n_bad_all").alias("n_bad"), "bad_rate")
    out = shared.lookup(rows, "pk", found, "rid", "inner")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    by_rule = reduce(lambda acc, r: F.when(F.col("rule") == r[0], F.lit(r[1])).otherwise(acc), rules,
                     F.when(F.col("bad_rate") >= REJECT, "block").otherwise("allow"))
    return out.withColumn("rule", rule).withColumn("verdict", by_rule).select(
        "id", "url", "host", "path", "rule", "verdict", "template", "n_labelled", "n_bad", "bad_rate")


def op2_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``pages`` URL. A page shows the document whose number is in its
    path; it is labelled bad when that document is of low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:[./]|$)", 1)
    pages = pages.withColumn("doc", F.when(number != "", number.cast("bigint")))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    pages = pages.join(labels, pages["doc"] == labels["doc_id"], "left")
    out = judged(pages.select(F.col("page_id").alias("id"), "url", "bad"))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "template", "n_labelled", "n_bad")
