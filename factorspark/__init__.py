"""Daily cross-sectional factor research on Spark DataFrames."""
