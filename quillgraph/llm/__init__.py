"""Operators for training data: duplicates, names, canonical values, token ids, mixes, residue."""
