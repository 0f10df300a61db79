"""Operators for building training corpora.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered
queries.  See the README for the method and the limits of each operator.
"""
