"""Farside: all-sky lunar-orbit interferometric imaging on Spark DataFrames."""
