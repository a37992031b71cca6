"""Incremental runs: landing, the paper pipeline and conversation history as Structured Streaming."""
