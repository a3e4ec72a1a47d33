"""Readers and writers: captured exchanges, canonical tables, logs, exports, storage."""
