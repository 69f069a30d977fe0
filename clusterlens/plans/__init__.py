"""Registered queries (``catalog``) and their DuckDB-runnable SQL twins
(``oracle``)."""
