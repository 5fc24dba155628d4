"""Row-keyed distributed arrays on Spark DataFrames."""
