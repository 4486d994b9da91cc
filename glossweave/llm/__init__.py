"""Operators for preparing training data: clustering, splits, sampling, packing, leaks and masking."""
