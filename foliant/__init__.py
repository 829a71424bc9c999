"""foliant: document extraction, quality and training-data operators on Spark DataFrames."""
