"""Operators over DataFrames of documents and commands."""
