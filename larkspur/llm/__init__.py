"""Operators for building training data: packing, mixing, counting, searching, deduplicating and filtering documents."""
