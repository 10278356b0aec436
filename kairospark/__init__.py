"""Point-in-time feature engineering and dataset building on Spark DataFrames."""
