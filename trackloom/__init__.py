"""trackloom: multi-sensor track analytics on Spark DataFrames."""
