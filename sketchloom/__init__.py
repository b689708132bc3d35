"""sketchloom: alignment-free sketch analytics on Spark DataFrames."""
