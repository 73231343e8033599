"""Operators on points, pixels, labels and graphs; each takes and gives DataFrames."""
