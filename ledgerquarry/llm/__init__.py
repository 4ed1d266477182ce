"""Operators that prepare training data: linkage, canonical names, survivorship, packing, leak search, subjects."""
