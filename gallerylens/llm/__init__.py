"""Operators for preparing training text: near and exact duplicates, packing, quality, tokens, filters.

Every operator takes DataFrames and returns DataFrames.  Nothing outside this folder imports it.
Rows whose ``doc_id`` is null, or repeated, stay: each row is judged for itself.
"""
