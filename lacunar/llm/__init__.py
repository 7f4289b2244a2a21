"""Training-data operators for document corpora.

Nothing outside this subpackage imports it. ``queries.py`` holds the thin
queries over the whole tables; every other module is one operator.
"""
