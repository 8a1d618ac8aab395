"""Operators of a training-data pipeline: extraction, search, filtering,
deduplication, packing, tokenization, classification, license scans.

Nothing else in the package imports this subpackage. Each operator is a
function from DataFrames to a DataFrame in a module of its own; ``queries``
holds the thin registered queries and ``oracle`` their DuckDB SQL.
"""
