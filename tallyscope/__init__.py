"""tallyscope: detection-review analytics on Spark DataFrames."""
