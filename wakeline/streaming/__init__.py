"""Structured Streaming: the batch transforms on streams, and what only streams need."""
