"""larkspur: feature engineering, modelling, evaluation and monitoring on Spark DataFrames."""
