"""Operators of a training-data pipeline over text, page, chat and embedding tables.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns DataFrames; `queries.py` binds them to the tables of a data folder.
"""
