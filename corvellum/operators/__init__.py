"""Operators over DataFrames; every one takes keyed rows and explicit ranks."""
