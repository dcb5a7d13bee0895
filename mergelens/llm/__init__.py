"""Operators for preparing language-model training data.

Nothing outside this package imports it; ``mergelens.llm.registry`` holds its queries.
"""
