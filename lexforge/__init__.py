"""lexforge: document analytics operators on Spark DataFrames."""
