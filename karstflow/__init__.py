"""A retrieval and data-processing engine on Spark DataFrames."""
