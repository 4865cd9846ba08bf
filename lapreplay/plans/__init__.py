"""Whole flows, from landed tables to stored datasets."""
