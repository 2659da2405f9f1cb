"""Operators over DataFrames: duplicates, facets, ordering, merging, worksets."""
