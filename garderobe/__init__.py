"""Wardrobe and outfit analytics on Spark DataFrames."""
