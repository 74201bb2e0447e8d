"""Operators for building training data: search, filtering, deduplication, tokenising and packing.

Nothing outside this subpackage imports it. ``registry`` lists the queries, ``queries`` and SQL
of each operator live next to the operator.
"""
