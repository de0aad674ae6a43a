"""tokenmill: text tokenisation and corpus analytics on Spark DataFrames."""
