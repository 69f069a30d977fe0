"""Inputs: readers for the file formats the workloads consume, and
derivations of those inputs from the benchmark tables."""

from clusterlens.sources.tables import table

__all__ = ["table"]
