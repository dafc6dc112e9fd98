"""Operators of a training-data pipeline: deduplication, decontamination, classification, packing, archives and token counts."""
