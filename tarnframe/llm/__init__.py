"""Operators for large training-corpus pipelines.

Nothing outside this subpackage imports it; ``registry`` lists the queries that
the entry module adds when the subpackage is present.
"""
