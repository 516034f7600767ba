"""Operators over DataFrames; each module holds one family."""
