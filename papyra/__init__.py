"""Document analytics on Spark: units, runs, chunks, costs and reports as DataFrames."""
