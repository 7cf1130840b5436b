"""Operators for preparing training data: one module per operator.

Nothing outside this package imports it, and each operator takes and returns DataFrames.
"""
