"""quillspark: evidence search and step-level trajectory analytics on Spark DataFrames."""
