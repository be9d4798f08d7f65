"""Training-data operators: language, duplicates, decontamination, mixing, sharding.

Each module holds one operator with its own interface; ``queries`` registers the
thin ``opN_<name>`` queries, ``sql`` their DuckDB twins. Nothing else in the
library imports this package.
"""
