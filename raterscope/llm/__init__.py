"""Operators of a training-data pipeline: cleaning, counting, packing and sharding of text corpora."""
