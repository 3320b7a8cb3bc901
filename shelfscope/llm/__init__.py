"""Training-data operators: archive reading, quality rules, de-duplication,
scoring, tokenising and mixing of whole document tables.

Nothing else in the library imports this package.
"""
