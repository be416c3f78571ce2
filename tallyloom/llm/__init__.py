"""Training-data operators: scoring, tokenising, deduplication, filtering and redaction of document tables.

Nothing else in the library imports this subpackage.  ``registry`` holds its queries and oracle SQL.
"""
