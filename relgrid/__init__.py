"""Relationship-based authorisation over Spark DataFrames."""
