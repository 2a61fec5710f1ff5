"""Company-lead analytics on Spark DataFrames."""
