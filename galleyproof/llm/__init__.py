"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; its queries live in
``galleyproof.llm.queries``.
"""
