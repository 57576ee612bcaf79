"""Column functions: text, page classes, URLs, policies."""
