"""Training-data operators: packing, filtering, formatting, deduplication, search and classification.

Every module holds one operator with a general interface; ``queries`` holds the registered queries and their SQL.
Nothing outside this subpackage imports it.
"""
