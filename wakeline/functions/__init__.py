"""Scalar column functions: text, decoding, URLs and paths, JSON, vectors, time."""
