"""Record cleaning, linking, phrase analysis and similarity on Spark DataFrames."""
