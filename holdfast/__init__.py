"""holdfast: customer-retention analytics on Spark DataFrames."""
