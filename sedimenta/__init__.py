"""sedimenta: a Spark-first engine for document graphs and training-data corpora."""
