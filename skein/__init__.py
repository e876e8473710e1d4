"""skein: search, graph and corpus operators declared on Spark DataFrames."""
