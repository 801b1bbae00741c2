"""Options backtesting and analytics on Spark DataFrames."""
