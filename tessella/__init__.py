"""tessella: corpus measurement and corpus engineering on Spark DataFrames."""
