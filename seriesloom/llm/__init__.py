"""Operators for preparing training data: clusters, sketches, splits, packing, mixing, residue."""
