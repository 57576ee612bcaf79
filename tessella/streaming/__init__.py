"""The time-driven operators as Structured Streaming queries."""
