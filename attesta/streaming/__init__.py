"""Run events as Structured Streaming plans, and the same rules in batch."""
