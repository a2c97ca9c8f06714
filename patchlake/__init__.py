"""patchlake: change-review analytics on Spark DataFrames."""
