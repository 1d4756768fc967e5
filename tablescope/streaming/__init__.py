"""Event-log folds in batch and Structured Streaming (2.K)."""
