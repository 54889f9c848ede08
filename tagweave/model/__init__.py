"""Sequence model: training, decoding, feature lines and templates."""
