"""Training-data operators: deduplication, classifiers, tokens, packing, search and media columns.

Nothing outside this subpackage imports it. Operators take and return DataFrames; the queries
registered by :mod:`stratum.llm.queries` apply them to the driver's tables.
"""
