"""Operators from day marts to decisions; each takes and returns DataFrames."""
