"""Storm-drainage network analysis on Spark DataFrames."""
