"""Matching, ranking and discovery analytics over Spark DataFrames."""
