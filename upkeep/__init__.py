"""Condition-based maintenance analytics for vehicle fleets, on Spark."""
