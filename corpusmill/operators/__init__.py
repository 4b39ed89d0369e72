"""Relational, sequence and interval operators on DataFrames."""
