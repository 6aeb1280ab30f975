"""Clustering of numeric vectors through similarity graphs, on Spark DataFrames."""
