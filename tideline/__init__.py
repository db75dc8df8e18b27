"""tideline: point-in-time analytics over Spark DataFrames."""
