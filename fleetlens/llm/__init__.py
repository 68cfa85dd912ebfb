"""Training-data operators over `documents` and `pages`, each a Spark job.

Nothing else in the library imports this subpackage. Every operator reads
DataFrames and returns DataFrames; `queries` registers the thin queries over
the given tables.
"""
