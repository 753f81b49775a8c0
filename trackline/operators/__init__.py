"""Operators on DataFrames. All are lazy and take their parameters, "now" and the local zone included, from the caller."""
