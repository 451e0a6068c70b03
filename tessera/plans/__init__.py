"""Compiling graphs to DataFrames."""
