"""Semi-structured text and tables as Spark DataFrames, through one declarative query."""
