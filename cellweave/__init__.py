"""Exact distance analytics on changing occupancy grids, and training-data preparation, on Spark DataFrames."""
