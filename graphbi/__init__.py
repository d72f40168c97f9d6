"""graphbi: social-network BI analytics on Spark DataFrames."""
