"""Operators of a large-scale training-data pipeline (optional subpackage).

Nothing outside this package imports it. Each module holds one operator with a
general interface; ``queries.py`` derives the registered queries from them.
"""
