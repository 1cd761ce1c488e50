"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames; Python
runs only inside tasks, on Arrow batches that Spark partitions and shuffles.
"""
