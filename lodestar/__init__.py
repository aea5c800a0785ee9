"""Search and graph retrieval over source code and documents, planned as Spark DataFrames."""
