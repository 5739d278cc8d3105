"""barflow: session-aware tick and bar analytics on Spark DataFrames."""
