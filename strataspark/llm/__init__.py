"""Operators of a training-data pipeline: joins on shingles, dedup, scoring, mixing.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and returns a DataFrame; thin ``opN_*`` queries live in ``queries.py``.
"""
