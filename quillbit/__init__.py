"""quillbit: text modelling and lossless-compression analytics on Spark DataFrames."""
