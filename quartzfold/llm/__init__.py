"""Operators for preparing very large training data.

Nothing outside this subpackage imports it.
"""
