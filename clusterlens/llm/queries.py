"""Registered queries of this folder and their DuckDB twins (where SQL can
express the operator; the others are held against brute force in tests/llm)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clusterlens.llm import (
    backoff_lm,
    line_runs,
    oph_dups,
    path_templates,
    polar_whitening,
    poisson_mix,
    resident_codes,
    rule_ledger,
    style_tree,
    suffix_spans,
    template_decontam,
    tool_links,
    warc_derive,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derive": warc_derive.op1_warc_derive,
    "op2_path_templates": path_templates.op2_path_templates,
    "op3_template_decontam": template_decontam.op3_template_decontam,
    "op4_tool_links": tool_links.op4_tool_links,
    "op5_line_runs": line_runs.op5_line_runs,
    "op6_rule_ledger": rule_ledger.op6_rule_ledger,
    "op7_poisson_mix": poisson_mix.op7_poisson_mix,
    "op8_oph_dups": oph_dups.op8_oph_dups,
    "op9_backoff_lm": backoff_lm.op9_backoff_lm,
    "op10_style_tree": style_tree.op10_style_tree,
    "op11_polar_whitening": polar_whitening.op11_polar_whitening,
    "op12_resident_codes": resident_codes.op12_resident_codes,
    "op13_suffix_spans": suffix_spans.op13_suffix_spans,
}

SQL: dict[str, str] = {
    "op5_line_runs": line_runs.OP5_SQL,
    "op6_rule_ledger": rule_ledger.OP6_SQL,
    "op7_poisson_mix": poisson_mix.OP7_SQL,
    "op8_oph_dups": oph_dups.OP8_SQL,
    "op12_resident_codes": resident_codes.OP12_SQL,
    "op13_suffix_spans": suffix_spans.OP13_SQL,
}
