"""keystrata: schema-driven keyed tables, postings, change folding and versioned snapshots on Spark DataFrames."""
