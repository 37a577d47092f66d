"""Training-data operators: extraction, counting, scoring, deduplication, mixing.

Nothing else in the library imports this subpackage.
"""
