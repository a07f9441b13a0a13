"""Wide-column analytics on Spark DataFrames."""
