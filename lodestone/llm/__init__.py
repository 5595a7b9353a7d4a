"""Training-data operators: dedup, packing, filters, classifiers, search and mixing.

Nothing outside this subpackage imports it.
"""
