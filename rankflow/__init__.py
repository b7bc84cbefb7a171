"""rankflow: offline product search, ranking and experiment analysis on Spark DataFrames."""
