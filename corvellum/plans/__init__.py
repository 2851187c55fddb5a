"""Queries: operators put together over the library's tables."""
