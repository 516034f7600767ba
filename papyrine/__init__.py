"""Papyrine: analytics over collections of scientific documents, on Spark DataFrames."""
