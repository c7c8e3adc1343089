"""Log rules as batch and as Structured Streaming."""
