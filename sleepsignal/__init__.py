"""Sleep-signal analytics on Spark DataFrames."""
