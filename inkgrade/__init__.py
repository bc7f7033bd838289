"""Assessment analytics as Spark DataFrames."""
