"""Operators for preparing training corpora: mixing, quality, dedup, decontamination, models."""
