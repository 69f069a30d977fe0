"""Operators of a large-scale training-data pipeline.

Each module holds one operator with its own general interface, the thin
``opN_*`` query that applies it to its whole table, and, where SQL can
express it, the DuckDB twin. ``queries.py`` collects them. Nothing outside
this folder (but ``corpus_pipeline.py``) imports it.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
