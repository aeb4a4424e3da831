"""Operators of a training-data pipeline over ``documents``-shaped tables.

Nothing outside this package imports it.  Each module holds one operator with
its own interface; ``queries.py`` has the thin registered queries and their
DuckDB SQL.  The package has to be importable by the Python workers.
"""
