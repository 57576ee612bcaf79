"""Analysis of captured web pages and search results as Spark jobs."""
