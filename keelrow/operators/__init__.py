"""Operators over DataFrames: checks, profiles, catalogs, diffs, changes."""
