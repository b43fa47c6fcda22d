"""Training-data operators: tokenising, filtering and deduplicating large text corpora.

Nothing outside this subpackage imports it.
"""
