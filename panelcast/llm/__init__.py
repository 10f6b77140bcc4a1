"""Operators for preparing training data: deduplication, decontamination, scoring, packing, search."""
