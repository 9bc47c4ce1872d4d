"""cairn: log analytics on Spark DataFrames."""
