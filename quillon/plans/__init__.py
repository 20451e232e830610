"""The query language: text to tokens, tokens to a tree, a tree to columns."""
