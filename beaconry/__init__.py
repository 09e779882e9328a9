"""Field-report analytics for Spark.

Everything is a lazily composed DataFrame: sources parse reports into typed
columns, operators turn DataFrames into DataFrames, plans bundle them into
named queries, streaming drives the same operators from ``foreachBatch``.
"""
