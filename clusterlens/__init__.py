"""clusterlens: runtime and corpus analytics as Spark DataFrame jobs.

Sub-packages:
  functions  - column-expression helpers (tokenising, Java-compatible parsing,
               IEEE division) that stay inside whole-stage codegen
  sources    - readers for the inputs (text corpora, song CSV lines, event
               logs, listener CSV, metric-sink files, node series, edge lists,
               network spells) and derivations of those inputs from tables
  operators  - DataFrame -> DataFrame operators, one module per family
  plans      - the registered queries and their SQL twins
  streaming  - Structured Streaming versions of the collation and event jobs
"""

__version__ = "0.1.0"
