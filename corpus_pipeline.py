"""The training-corpus pipeline: quality rules, line dedup, near-duplicate
removal, benchmark decontamination, mixing to target weights.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. Every stage but the last returns the columns of ``documents``;
the mix adds ``copy`` and ``shuffle_key``. Rows that a stage is not asked to
judge pass through it unchanged; nulls, empty texts, repeated rows, empty
tables and further columns are handled as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm import line_runs, oph_dups, poisson_mix, rule_ledger, shared, template_decontam
from clusterlens.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the standard policy."""
    return rule_ledger.keep_passing(docs, rule_ledger.STANDARD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more of them hold (which stay
    in the largest doc_id); n_chars follows the text."""
    out = line_runs.line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the smallest doc_id."""
    return oph_dups.drop_near_duplicates(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    out = template_decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target source weights, in global shuffle order."""
    return poisson_mix.poisson_mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicate removal", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
]

# Template canonicalisation has no SQL form; tests/llm holds the pipeline
# against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is a written table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
