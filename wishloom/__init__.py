"""Free-text request analytics on Spark: columns in, columns out."""
