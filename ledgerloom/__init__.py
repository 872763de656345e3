"""Ledgerloom: deletion-audit analytics on Spark DataFrames."""
