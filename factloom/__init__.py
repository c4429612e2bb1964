"""factloom: analytics over tables of static-analysis evidence, on Spark DataFrames."""
