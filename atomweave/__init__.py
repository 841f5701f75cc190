"""Trajectory analytics on Spark DataFrames, with a corpus-preparation subpackage."""
