"""corvane: ordered-signal, vector and token analytics on Spark DataFrames."""
