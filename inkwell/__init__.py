"""inkwell: document analytics on Spark DataFrames."""
