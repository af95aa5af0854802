"""Operators for building training data: tokens, packing, dedup, decontamination, filters, formatting."""
