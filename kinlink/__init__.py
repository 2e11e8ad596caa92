"""Business-record matching and analytics on Spark DataFrames."""
