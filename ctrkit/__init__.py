"""ctrkit: click-through and audience-expansion features on Spark DataFrames.

Sub-packages:
  sources    scans and sinks (CSV, text profile records, partitioned tables, models)
  functions  Column-level helpers (tokens, crosses, digamma, hashing)
  operators  DataFrame -> DataFrame operators (cleaning, joins, statistics,
             smoothing, encoders, models, evaluation)
  plans      stand-in inputs built from the test tables and the query catalogue
  streaming  incremental click / impression statistics with Structured Streaming
"""

__version__ = "0.1.0"
