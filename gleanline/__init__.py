"""gleanline: list extraction, record matching and usage analytics on Spark DataFrames."""
