"""Column expressions: the text analyzer and the relevance formula."""
