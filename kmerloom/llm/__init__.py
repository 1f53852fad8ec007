"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it. ``queries`` and ``oracle_sql`` in
:mod:`kmerloom.llm.queries` are picked up by the entry file when present.
"""
