"""Training-data operators: archives, text filters, near-duplicates, tokens and exact search.

Nothing outside this folder imports it.  Operators take and return DataFrames; the registered queries are in
``queries.py``.
"""
