"""Importing this registers all queries."""

from lodestone.plans import assembly_queries, corpus_queries, extract_queries, search_queries, session_queries, stream_queries, vector_queries  # noqa: F401
