"""Analytical operators over ordinary DataFrames."""
