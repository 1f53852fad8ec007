"""kmerloom: k-mer, splice-structure and training-data analytics on Spark DataFrames."""
