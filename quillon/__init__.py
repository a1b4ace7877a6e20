"""quillon: analytics operators that take and return Spark DataFrames."""
