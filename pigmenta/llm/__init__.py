"""Operators of a training-data pipeline: quality, near duplicates, decontamination, mixing, token files."""
