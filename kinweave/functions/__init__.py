"""Column functions: normalization, keys, similarity and pair features."""
