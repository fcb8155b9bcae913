"""A log-structured key-value analytics engine on Spark DataFrames."""
