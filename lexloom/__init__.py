"""lexloom: texts as tables, on Spark DataFrames."""
