"""Training-data operators: file hygiene, similarity joins, vector search, tokenization and mixing.

Nothing outside this package imports it; ``queries`` holds its query registry.
"""
