"""Detection and repair of errors in tables, planned as Spark DataFrames."""
