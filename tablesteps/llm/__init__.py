"""Operators for building training data from a corpus of documents, pages and embeddings.

Nothing outside this folder imports it. ``queries.py`` registers one query per operator.
"""
