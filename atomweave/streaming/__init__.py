"""Structured Streaming: metrics, sessions, presence and late work."""
