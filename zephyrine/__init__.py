"""Time-series validation engine built on Spark DataFrames."""
