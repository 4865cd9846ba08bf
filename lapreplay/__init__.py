"""Leakage-safe replay of lap tables for many races at once, as Spark DataFrames."""
