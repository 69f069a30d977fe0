"""Operator 7: mixing sources to target weights by Poisson replication.

A source's target rate is how often each of its documents should appear:
``rate = budget * weight / size`` with sizes in characters, one aggregation
over all documents. A document's number of copies is drawn from the Poisson
distribution with that mean by inverting its cumulative distribution at a
uniform number hashed from (seed, doc_id): the number of cumulative
probabilities that the number reaches. So the draw needs no state, is the
same on every run and every partitioning, and a copy set only grows when the
rate grows. Copies are exploded and put in a global order by a hash of
(seed, doc_id, copy).

DataFrame functions only. The weights are a parameter: at most MAX_SOURCES
named sources; all other sources (and null) share ``rest`` in proportion to
their sizes, that is at one rate. The table of rates thus has at most
MAX_SOURCES + 1 rows and is broadcast: a source that holds a third of all
rows is neither shuffled nor gathered. Sizes are summed map-side first. The
cumulative table of one source has about rate + 12 * sqrt(rate) + 30 entries; a
rate above MAX_RATE is drawn as the sum of independent draws at equal parts of
it (a sum of Poisson numbers is one of the summed mean), so no table grows beyond
that. The only shuffle of texts is the final one: the key is uniform, so
ranges of equal width are equally full, and no pass has to sample it.

Defined results: a null source belongs to the rest; a null or empty text
counts 0 characters but is drawn like any other document; a weight of 0 drops
a source; a named source without characters has rate 0; a null doc_id is drawn
by a hash of its text; rows of one doc_id get the same draw; an empty table
gives an empty table; columns named ``copy`` or ``shuffle_key`` are replaced,
all others pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm import shared
from clusterlens.sources.tables import table

MAX_SOURCES = 10_000
MAX_RATE = 10_000.0
SEED = 7

# Production mix: the large web source is halved, three are favoured.
WEIGHTS = {"src0": 0.18, "src1": 0.08, "src2": 0.08, "src3": 0.08}
REST = 0.58


def unit_hash(*parts: Column) -> Column:
    """A uniform number in (0, 1) from the parts: 52 bits of their MD5."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)


def cumulative(rate: Column) -> Column:
    """Cumulative Poisson probabilities P(X <= k) for k = 0, 1, ... until the
    rest is below double precision. Probabilities are built in logarithms, so
    large rates do not underflow."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.lit(0.0).alias("lg"), F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        lg = acc["lg"] + F.log(k.cast("double"))
        p = acc["p"] + F.exp(k * F.log(rate) - rate - lg)
        return F.struct(lg.alias("lg"), p.alias("p"), F.concat(acc["cdf"], F.array(p)).alias("cdf"))

    table_ = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])
    return F.when(rate > 0, table_).otherwise(F.array(F.lit(1.0)))


def _check(weights: dict[str, float], rest: float) -> None:
    if len(weights) > MAX_SOURCES:
        raise ValueError(f"at most {MAX_SOURCES} named sources")
    if any(not math.isfinite(w) or w < 0 for w in [*weights.values(), rest]):
        raise ValueError("weights must be finite and not negative")


def group_of(source: Column, weights: dict[str, float]) -> Column:
    """The named source, or null for the rest."""
    return F.when(source.isin(list(weights)), source) if weights else F.lit(None).cast("string")


def rates(docs: DataFrame, weights: dict[str, float], rest: float = 0.0, budget: float = 1.0,
          source: str = "source", text: str = "text") -> DataFrame:
    """(grp, rate): the mean number of copies for each named source and the
    rest (grp null). ``budget`` is the mixed corpus's size over the input's."""
    _check(weights, rest)
    spark = docs.sparkSession
    total = sum(weights.values()) + rest
    plan = [(s, w / total if total else 0.0) for s, w in sorted(weights.items())] + [(None, rest / total if total else 0.0)]
    plan = spark.createDataFrame(plan, "grp string, weight double")
    sizes = docs.groupBy(group_of(F.col(f"`{source}`"), weights).alias("grp")).agg(
        F.coalesce(F.sum(F.char_length(F.col(f"`{text}`"))), F.lit(0)).cast("double").alias("size"))
    # at most MAX_SOURCES + 1 rows from here on
    known = sizes.select(F.struct("grp", "size").alias("g"))
    known = known.agg(F.collect_list("g").alias("g"), F.sum("g.size").alias("all"))
    known = known.select(F.explode("g").alias("g"), "all").select("g.grp", "g.size", "all")
    out = plan.join(F.broadcast(known), plan["grp"].eqNullSafe(known["grp"]), "inner")
    rate = F.when(F.col("size") > 0, F.col("weight") * F.lit(float(budget)) * F.col("all") / F.col("size")).otherwise(0.0)
    return out.select(plan["grp"], rate.alias("rate"))


def _drawn(u: Column) -> Column:
    """The Poisson number at ``u``: how many cumulative probabilities it reaches."""
    return F.size(F.filter("cdf", lambda c: c <= u))


def _further(seed: int) -> Column:
    """The sum of the second and later draws, where a rate is drawn in parts."""
    later = F.transform(F.sequence(F.lit(2), F.col("draws")),
                        lambda j: _drawn(unit_hash(F.lit(seed), F.col("ident"), F.lit("part"), j)))
    return F.when(F.col("draws") > 1, F.aggregate(later, F.lit(0), lambda a, x: a + x)).otherwise(0)


def poisson_mix(docs: DataFrame, weights: dict[str, float] = WEIGHTS, rest: float = REST, budget: float = 1.0,
                seed: int = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed corpus: ``docs`` rows times their Poisson counts, with ``copy``
    (1, 2, ...) and ``shuffle_key``, partitioned and ordered by that key."""
    docs = shared.without(docs, "copy", "shuffle_key")
    found = rates(docs, weights, rest, budget, source, text)
    draws = F.greatest(F.ceil(F.col("rate") / MAX_RATE).cast("int"), F.lit(1))
    known = found.select("grp", draws.alias("draws"), cumulative(F.col("rate") / draws).alias("cdf"))
    ident = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.concat(F.lit("text "), F.xxhash64(F.col(f"`{text}`")).cast("string")))
    rows = shared.packed(docs, source=group_of(F.col(f"`{source}`"), weights), ident=ident)
    rows = rows.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("grp")), "inner")
    rows = rows.withColumn("u", unit_hash(F.lit(seed), F.col("ident")))
    rows = rows.withColumn("n", _drawn(F.col("u")) + _further(seed)).where("n > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    rows = rows.withColumn("shuffle_key", unit_hash(F.lit(seed), F.col("ident"), F.col("copy")))
    rows = rows.select("row.*", "copy", "shuffle_key")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col("shuffle_key") * parts).cast("int")
    return rows.repartitionById(parts, part).sortWithinPartitions("shuffle_key", "copy")


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed to the production weights."""
    return poisson_mix(table(spark, sf_dir, "documents"))


def mix_sql(documents: str = "documents", weights: dict[str, float] = WEIGHTS, rest: float = REST,
            budget: float = 1.0, seed: int = SEED) -> str:
    """DuckDB twin of ``poisson_mix`` over a relation with documents' columns."""
    total = sum(weights.values()) + rest
    plan = ", ".join([f"('{s}', {w / total!r}::DOUBLE)" for s, w in sorted(weights.items())] + [f"(NULL, {rest / total!r}::DOUBLE)"])
    names = ", ".join(f"'{s}'" for s in weights)
    uniform = "((('0x' || substr(md5({0}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"
    return f"""
WITH plan(grp, weight) AS (VALUES {plan}),
d AS (SELECT *, CASE WHEN source IN ({names}) THEN source END AS grp FROM {documents}),
z AS (SELECT grp, coalesce(sum(length(text)), 0)::DOUBLE AS size FROM d GROUP BY grp),
r AS (SELECT plan.grp, CASE WHEN size > 0 THEN weight * {budget!r}::DOUBLE * (SELECT sum(size) FROM z) / size ELSE 0.0 END AS rate
      FROM plan JOIN z ON plan.grp IS NOT DISTINCT FROM z.grp),
k AS (SELECT grp, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 31)::BIGINT)) AS k FROM r),
p AS (SELECT grp, k, sum(CASE WHEN rate = 0 THEN (k = 0)::INT::DOUBLE
          ELSE exp(k * ln(rate) - rate - lgamma(k + 1)) END) OVER (PARTITION BY grp ORDER BY k) AS cdf FROM k),
u AS (SELECT d.*, {uniform.format(f"'{seed}:' || doc_id")} AS u FROM d),
n AS (SELECT u.doc_id, count(*) AS n FROM u JOIN p ON u.grp IS NOT DISTINCT FROM p.grp AND p.cdf <= u.u GROUP BY u.doc_id),
c AS (SELECT {documents}.*, unnest(range(1, n + 1)) AS copy FROM {documents} JOIN n ON {documents}.doc_id = n.doc_id)
SELECT * EXCLUDE (copy), copy::INT AS copy, {uniform.format(f"'{seed}:' || doc_id || ':' || copy")} AS shuffle_key FROM c
"""


OP7_SQL = mix_sql()
