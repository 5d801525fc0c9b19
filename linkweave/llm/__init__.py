"""Operators for large training-data pipelines (see ``queries.py`` for the registered ones).

Nothing outside this subpackage imports it; it may import general helpers of
the library (sessions, ranking, registration).
"""
