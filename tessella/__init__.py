"""Analytics over gridded, multi-pass sensor measurements, on Spark DataFrames."""
