"""Document retrieval, trust scoring and ingest on Spark DataFrames."""
