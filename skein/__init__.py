"""skein: sequence and set analytics on Spark DataFrames."""
