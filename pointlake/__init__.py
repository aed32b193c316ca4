"""Point-cloud, pose-candidate and training-data operators on Spark DataFrames."""
