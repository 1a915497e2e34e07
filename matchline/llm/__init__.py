"""Operators for training data: counting, filtering, deduplicating, packing and sharding text at scale."""
