"""Gatewright: Boolean example tables, gate networks and training-data preparation on Spark DataFrames."""
