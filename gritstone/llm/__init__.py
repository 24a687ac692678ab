"""Operators of a training-data pipeline: one module an operator, their queries in ``queries``.

Nothing outside this subpackage imports it.
"""
