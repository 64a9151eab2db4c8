"""Training-data operators: deduplication, tokens, packing, language and secrets.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; ``queries`` holds the registered queries built on them.
"""
