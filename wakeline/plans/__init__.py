"""Whole queries: the operators applied to the supplied tables, with their SQL twins."""
