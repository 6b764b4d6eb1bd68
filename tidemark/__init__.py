"""tidemark: versioned key-value analytics on Spark DataFrames.

A changelog of puts and deletes, totally ordered by sequence, is folded into the newest live
value of each key; runs are merged and compacted by levels, manifests and logs are replayed.
"""
