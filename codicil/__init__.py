"""Analytics over versioned, effective-dated policy documents, expressed in Spark DataFrames."""
