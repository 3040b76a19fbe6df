"""Operators for building training corpora at scale: deduplication, filtering, tokenising, packing, media.

The rest of the library never imports this subpackage; its queries are in :mod:`tidemark.llm.queries`.
"""
