"""Scans: files in landing storage to typed DataFrames."""
