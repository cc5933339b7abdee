"""Relational operators: chunking, point store, search, listing."""
