"""Record matching and corpus preparation on Spark DataFrames."""
